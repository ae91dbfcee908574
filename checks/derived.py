"""Seeds, pages and postal rows derived row by row from the given tables.

The given ``pages`` hold no ``tel:`` link, no followed link and no postal code, so the crawl
operators read sites made of all ``orders`` (home pages), all ``lineitem`` rows (sub-pages; rows
that share an order and a line number are copies of one url) and all ``nation`` rows (partner
pages that many sites link to). The SQL runs unchanged on Spark and DuckDB, without a shuffle.
"""

SEEDS = """
SELECT o_orderkey AS seed_ord, 'site' || CAST(o_orderkey AS string) || '.example.com' AS domain
FROM orders
"""

_AREA = "lpad(CAST(200 + {k} % 700 AS string), 3, '0')"
_LINE = "lpad(CAST({k} % 10000 AS string), 4, '0')"


def _tel(i: int) -> str:
    """One tel: link; sites have 0 to 4 of them."""
    area, line = _AREA.format(k=f"(o_custkey + {i})"), _LINE.format(k=f"(o_orderkey + {i})")
    styles = [
        f"'<a class=x href=\"tel:+1 (' || {area} || ') 555-' || {line} || '\">call</a>'",
        f"'<a href=''tel:1' || {area} || '555' || {line} || '''>call</a>'",
        f"'<a href=tel:' || {area} || '.555.' || {line} || '>call</a>'",
        f"'<A HREF=\"tel:tel:&#43;1' || {area} || '&#53;55' || {line} || '\">call</A>'",
    ]
    return f"CASE WHEN o_orderkey % 5 > {i} THEN {styles[i]} ELSE '' END"


HOME_PAGES = f"""
SELECT o_orderkey AS page_id,
  'https://site' || CAST(o_orderkey AS string) || '.example.com' AS url,
  '<html><head><title>Call 2025550199</title><script>var n="3125550142";</script></head><body><nav>'
  || '<a title="us > them" href="/contact/1">Contact</a><!-- <a href="/contact/99">old</a> -->'
  || '<a href="/About-Us/2">About</a><a href="/SUPPORT/3.PDF">Manual</a>'
  || '<a href="/products/4">Products</a><a href="https://facebook.com/contact/'
  || CAST(o_orderkey AS string) || '">fb</a><a href="https://Facebook.com/help">fb</a>'
  || '<a href="https://partner' || CAST(o_custkey % 25 AS string) || '.example.net/help">Partner</a>'
  || '<a href="mailto:help@site' || CAST(o_orderkey AS string) || '.example.com">Mail</a>'
  || '<a href="/service/5?x=1&amp;y=2">Service</a><a href=''store/6''>Store</a>'
  || '<a href=/legal/7#terms>Legal</a><a href="#top">Top</a><a href="Tel:2025550100">T</a>'
  || {_tel(0)} || {_tel(1)} || {_tel(2)} || {_tel(3)}
  || '</nav><div><p>Total ' || CAST(o_orderkey * 7919 AS string) || '</p></div></body></html>' AS html
FROM orders
"""

CHILD_PAGES = f"""
SELECT 1000000000 + l_partkey AS page_id,
  'https://site' || CAST(l_orderkey AS string) || '.example.com' || CASE l_linenumber
    WHEN 1 THEN '/contact/1' WHEN 2 THEN '/About-Us/2' WHEN 3 THEN '/SUPPORT/3.PDF'
    WHEN 4 THEN '/products/4' WHEN 5 THEN '/service/5?x=1&y=2' WHEN 6 THEN '/store/6'
    ELSE '/legal/7' END AS url,
  '<html><body><div data-x="1 > 2025550109"><p>Office ' || CASE WHEN l_partkey % 3 = 0
    THEN lpad(CAST(l_partkey % 1000 AS string), 5, '0') || ' and 99999' ELSE 'HQ' END
  || '</p><p>Call ' || CASE l_partkey % 8
    WHEN 0 THEN '(' || {_AREA.format(k='l_partkey')} || ')&nbsp;555-' || {_LINE.format(k='l_partkey')}
    WHEN 1 THEN {_AREA.format(k='l_partkey')} || '.555.' || {_LINE.format(k='l_partkey')}
    WHEN 2 THEN '+1 ' || {_AREA.format(k='l_partkey')} || '-555-<b>' || {_LINE.format(k='l_partkey')} || '</b>'
    WHEN 3 THEN '800-555-HELP'
    WHEN 4 THEN '1685551234 or 17905551234 or 5555555123'
    WHEN 5 THEN '0' || {_AREA.format(k='l_partkey')} || '5550' || lpad(CAST(l_partkey % 1000 AS string), 3, '0')
    WHEN 6 THEN '+65 6555-' || {_LINE.format(k='l_partkey')} || ', +6565550' || lpad(CAST(l_partkey % 1000 AS string), 3, '0')
      || ' 1-' || {_AREA.format(k='l_partkey')} || '-555-' || {_LINE.format(k='l_partkey')}
      || ', +599717' || {_LINE.format(k='l_partkey')} || ', +378666' || {_LINE.format(k='l_partkey')}
    ELSE '4465758382889' || lpad(CAST(l_partkey % 1000 AS string), 3, '0') END
  || '</p></div></body></html>' AS html
FROM lineitem
"""

PARTNER_PAGES = f"""
SELECT 2000000000 + n_nationkey AS page_id,
  'https://partner' || CAST(n_nationkey AS string) || '.example.net/help' AS url,
  '<html><body><ul><li>Desk: ' || {_AREA.format(k='(n_nationkey * 31)')} || ' 555 0100<li>Night: '
  || {_AREA.format(k='(n_nationkey * 17)')} || '-555-0111</ul></body></html>' AS html
FROM nation
"""

# Pages whose numbers are split over nested elements: one per order.
NESTED_PAGES = f"""
SELECT o_orderkey AS page_id, 'https://nest' || CAST(o_orderkey AS string) || '.example.com' AS url,
  '<html><body><div class="a > b">Call <section><p>' || {_AREA.format(k='o_custkey')} || '-555-</p><p>'
  || {_LINE.format(k='o_orderkey')} || '</p></section> or <span>' || {_AREA.format(k='o_orderkey')} || '</span></div><ul><li>'
  || {_AREA.format(k='o_orderkey')} || '.555.' || {_LINE.format(k='o_custkey')} || '<li>2</ul>3125550142</body></html>' AS html
FROM orders
"""

# Texts with postal codes, numbers of other lengths and codes inside words.
POSTAL_TEXTS = """
SELECT doc_id, text || ' Office ' || lpad(CAST(doc_id * 37 % 100000 AS string), 5, '0') || ', or '
  || lpad(CAST(doc_id % 1000 AS string), 5, '0') || '-' || lpad(CAST(doc_id % 1000 AS string), 5, '0')
  || '; no x' || lpad(CAST(doc_id % 99991 AS string), 5, '0') || ' 1234567' AS text
FROM documents
"""

# The two country tables a postal reference is built from: zips occur in both, and repeatedly.
POSTAL_CA = "SELECT lpad(CAST(c_custkey % 1000 AS string), 5, '0') AS Zip FROM customer WHERE c_acctbal < 0"
POSTAL_US = "SELECT lpad(CAST(c_custkey % 1000 AS string), 5, '0') AS Zip FROM customer WHERE c_acctbal >= 0"

CRAWL_PAGES = f"{HOME_PAGES} UNION ALL {CHILD_PAGES} UNION ALL {PARTNER_PAGES}"

# The feed of the streaming jobs: all copies under their real urls, dealt to batches that follow each other.
FEED_BATCHES = 3
FEED_PAGES = f"""
SELECT page_id, url, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS parent_url, html,
  page_id % {FEED_BATCHES} AS batch FROM ({CRAWL_PAGES})
"""
