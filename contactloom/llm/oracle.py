"""DuckDB SQL for the rows of the queries that SQL can express."""

from contactloom.llm import chat_format, license_scan, mixing, quality, ranked_search


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(_text(v) for v in values) + "]"


LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def alnum(column: str) -> str:
    lowered = LOWER.format(column)
    return f"list_filter(string_split_regex({lowered}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"


def spaced(column: str) -> str:
    return f"list_filter(string_split_regex(coalesce({column}, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"


def license_sql() -> str:
    places = []
    for phrase, label in license_scan.BASE_PHRASES:
        same = " AND ".join(f"w[i + {k + 1}] = {_text(p)}" for k, p in enumerate(phrase.split()))
        places.append(
            f"list_transform(list_filter(range(len(w)), lambda i: {same}), lambda i: {{'s': i, 'l': {_text(label)}}})"
        )
    templates = ", ".join(
        f"({n}, {_text(t.label)}, {_list(t.tokens)}, {t.needed}, {t.window})" for n, t in enumerate(license_scan.prepared())
    )
    return f"""
WITH templates(n, label, tokens, needed, win) AS (VALUES {templates}),
words AS (SELECT doc_id, text, {alnum('text')} AS w FROM documents),
placed AS (SELECT doc_id, len(w) AS n_words, {' || '.join(places)} AS p FROM words),
candidates AS (SELECT doc_id, w, label, tokens, needed, win FROM words, templates WHERE len(list_intersect(w, tokens)) >= needed),
measured AS (SELECT doc_id, label, tokens, needed, list_max(list_transform(
               list_filter(range(len(w)), lambda i: list_contains(tokens, w[i + 1])),
               lambda i: len(list_intersect(w[i + 1:i + win], tokens)))) AS shared
             FROM candidates),
found AS (SELECT doc_id, list(DISTINCT label) AS found, max(shared / len(tokens)) AS best
          FROM measured WHERE shared >= needed GROUP BY doc_id)
SELECT doc_id, n_words::BIGINT AS n_words, len(p)::BIGINT AS n_base,
       list_min(list_transform(p, lambda x: x.s))::BIGINT AS first_word,
       list_max(list_transform(p, lambda x: x.s))::BIGINT AS last_word,
       coalesce(array_to_string(list_sort(list_distinct(list_transform(p, lambda x: x.l))), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_transform(p, lambda x: x.l) || coalesce(found, []))), ','), '') AS labels,
       CASE WHEN len(p) > 0 THEN 1.0 ELSE coalesce(best, 0.0) END::DOUBLE AS score
FROM placed LEFT JOIN found USING (doc_id)"""


def jaccard_sql() -> str:
    lowered = LOWER.format("text")
    return f"""
WITH RECURSIVE words AS (SELECT doc_id, {spaced(lowered)} AS w FROM documents),
sets AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(list_transform(range(greatest(len(w) - 4, 1)), lambda i: array_to_string(w[i + 1:i + 5], ' '))) AS s
  FROM words WHERE len(w) > 0),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS MATERIALIZED (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT a AS doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(b) AS component_id
FROM reach LEFT JOIN sizes ON sizes.doc_id = a GROUP BY a"""


def contamination_sql() -> str:
    return f"""
WITH items AS (SELECT item_id, {alnum('text')} AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, least(len(w), 13) AS n,
              unnest(list_transform(range(greatest(len(w) - 12, 1)), lambda i: array_to_string(w[i + 1:i + 13], ' '))) AS t
            FROM items WHERE len(w) > 0),
docs AS MATERIALIZED (SELECT doc_id, {alnum('text')} AS w FROM documents),
lengths AS (SELECT DISTINCT n FROM windows),
cut AS (SELECT doc_id, n, unnest(range(len(w) - n + 1)) AS pos, w FROM docs, lengths WHERE len(w) >= n),
hits AS MATERIALIZED (SELECT doc_id, pos, cut.n, item_id FROM cut JOIN windows ON windows.n = cut.n AND t = array_to_string(w[pos + 1:pos + cut.n], ' ')),
hit AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS place FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS ids FROM hits GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(ids), 0)::BIGINT AS n_items,
       sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN found USING (doc_id)"""


def quality_sql() -> str:
    r = quality.Rules()
    return f"""
WITH words AS MATERIALIZED (SELECT doc_id, source, coalesce(text, '') AS text, {spaced('text')} AS w FROM documents),
windows AS (SELECT doc_id, unnest(range(len(w) - 4)) AS pos, w FROM words WHERE len(w) >= 5),
repeated AS (SELECT doc_id, pos FROM (
  SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, array_to_string(w[pos + 1:pos + 5], ' ')) AS n FROM windows) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(pos, pos + 5)) AS place FROM repeated) GROUP BY doc_id),
lines AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS x FROM words),
measured AS MATERIALIZED (
  SELECT doc_id, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
         (len(x) - len(list_distinct(x)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM words JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)),
base AS (SELECT *, n_words < {r.min_words} OR 100 * n_repeat_words > {r.max_repeat_percent} * n_words AS base_failed FROM measured),
judged AS MATERIALIZED (
  SELECT *, base_failed OR 100 * n_symbols > {r.max_symbol_percent} * n_words OR 100 * n_dup_lines > {r.max_dup_line_percent} * n_words
         OR 10 * word_chars < {r.min_word_chars_x10} * n_words OR 10 * word_chars > {r.max_word_chars_x10} * n_words AS soft_failed FROM base),
hosts AS (SELECT source, count(*) AS n, count(*) FILTER (soft_failed) AS k FROM judged GROUP BY source),
moments AS (SELECT sum(k) / sum(n) AS mean, coalesce(var_samp(k / n), 0) AS var FROM hosts),
prior AS (SELECT mean, CASE WHEN var > 0 THEN greatest(2.0, mean * (1 - mean) / var - 1)
                            WHEN mean * (1 - mean) <> 0 THEN 1e6 ELSE 2.0 END AS weight FROM moments),
verdicts AS (SELECT source, (k + mean * weight) / (n + weight) > {r.bad_host_rate} AS host_failed FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (host_failed AND soft_failed) AS kept, host_failed, soft_failed
FROM judged JOIN verdicts ON judged.source IS NOT DISTINCT FROM verdicts.source"""


def chat_sql() -> str:
    said = "'</s>[INST] ok [/INST]'"
    control = "/?(?:s>|ROLE\\]|TURN\\]|INST\\])"
    assert control == chat_format.CONTROL

    def escaped(column: str) -> str:
        return f"length(regexp_replace({column}, '([<\\[])(\\\\*)({control})', '\\1\\\\\\2\\3', 'g'))"

    return f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', {said}), (-7, 1, 'assistant', {said})),
led AS (SELECT *, lag(role) OVER w AS before FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
sized AS (
  SELECT *, {escaped('text')} + CASE WHEN before = role THEN 6
    ELSE 16 + {escaped('role')} + CASE WHEN before IS NULL THEN 0 ELSE 4 END END AS n FROM led)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (sum(n) + 4)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id"""


def warc_sql() -> str:
    digits = "('0x' || h[5 * i + 1:5 * i + 5])::INTEGER"
    letters = " || ".join(f"('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')[(({digits} >> {s}) & 31) + 1]" for s in (15, 10, 5, 0))
    return f"""
WITH hashed AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
first AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM hashed)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(8), lambda i: {letters}), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM first"""


def search_sql() -> str:
    return f"""
WITH words AS MATERIALIZED (SELECT row_number() OVER () AS d, doc_id, {alnum('text')} AS w FROM documents),
sizes AS MATERIALIZED (SELECT d, doc_id, len(w)::BIGINT AS n FROM words WHERE len(w) > 0),
total AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM sizes),
norms AS MATERIALIZED (SELECT d, doc_id, 100 - 75 + ((75 * n * n_docs) // n_terms) AS m FROM sizes, total),
counts AS MATERIALIZED (SELECT d, t, count(*)::BIGINT AS tf FROM (SELECT d, unnest(w) AS t FROM words) GROUP BY ALL),
items AS (SELECT item_id, unnest({alnum('text')}) AS t FROM (SELECT DISTINCT item_id, text FROM benchmark)),
asked AS MATERIALIZED (SELECT item_id, t, count(*)::BIGINT AS times FROM items GROUP BY ALL),
weights AS MATERIALIZED (
  SELECT t, floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM counts, total WHERE t IN (SELECT t FROM asked) GROUP BY t),
scored AS (
  SELECT item_id, d, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM asked JOIN weights USING (t) JOIN counts USING (t) JOIN norms USING (d) GROUP BY ALL)
SELECT item_id, rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank
      FROM scored WHERE score > 0)
WHERE rank <= {ranked_search.K}"""


def crc32_sql(text: str) -> str:
    """Unsigned crc32 of a text of ASCII; the table follows from the polynomial."""
    table = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        table.append(n)
    step = f"xor(c >> 8, ({table}::BIGINT[])[(xor(c, b) & 255) + 1])"
    codes = f"list_transform(range(1, length({text}) + 1), lambda i: ascii(({text})[i])::BIGINT)"
    return f"xor(list_reduce([4294967295::BIGINT] || {codes}, lambda c, b: {step}), 4294967295)"


def trie_sql() -> str:
    return f"""
WITH turns AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
                      row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS p
               FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT c, c - c % 100 AS base, {crc32_sql('c::VARCHAR')} % 6 AS h FROM (SELECT DISTINCT c FROM turns)),
rebuilt AS (
  SELECT convs.c, p, role, text FROM convs JOIN turns USING (c) WHERE p >= h
  UNION ALL SELECT convs.c, p, role, text FROM convs JOIN turns ON turns.c = base WHERE p < h),
whole AS MATERIALIZED (
  SELECT c, coalesce(list([role, text] ORDER BY p) FILTER (p IS NOT NULL), []) AS t FROM convs LEFT JOIN rebuilt USING (c) GROUP BY c),
prefixes AS MATERIALIZED (SELECT c, d, t[1:d] AS k, d = len(t) AS ended FROM (SELECT c, t, unnest(range(len(t) + 1)) AS d FROM whole)),
nodes AS MATERIALIZED (
  SELECT d, k, min(c) AS c, count(*) AS n, coalesce(length(k[d][2]), 0) AS chars,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ended), '')) AS ends
  FROM prefixes GROUP BY d, k),
above AS (SELECT p.d, p.k, count(*) FILTER (x.d = p.d + 1) AS n_children, sum((x.n - 1) * x.chars) AS saved,
                 count(*) FILTER (NOT EXISTS (SELECT 1 FROM nodes y WHERE y.d = x.d + 1 AND y.k[1:x.d] = x.k)) AS n_leaves
          FROM nodes x JOIN prefixes p ON p.c = x.c AND p.d <= x.d GROUP BY p.d, p.k)
SELECT nodes.c AS conv_id, nodes.d AS depth, up.c AS parent_conv_id, nodes.n AS n_convs, n_children::BIGINT AS n_children,
       n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, nodes.ends AS ends_sha256
FROM nodes JOIN above USING (d, k) LEFT JOIN nodes up ON up.d = nodes.d - 1 AND up.k = nodes.k[1:nodes.d - 1]"""


def mixing_sql() -> str:
    stop = mixing.MAX_EPOCHS
    taken = " + ".join(
        f"greatest(0, least(size, floor(target)::BIGINT - ({e} * source_size + place)))" for e in range(stop)
    )
    return f"""
WITH sized AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, source, len({spaced('text')})::BIGINT AS size,
         md5(concat_ws(':', '0', doc_id::VARCHAR, text)) AS o FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size,
                   1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} AS weight FROM sized GROUP BY source),
-- the sources that stop are those of the least size per weight
by_room AS (
  SELECT *, sum(source_size) OVER () AS total,
         sum({stop} * source_size) OVER before AS stopped, sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS free
  FROM sources WINDOW before AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (SELECT *, ((total - coalesce(stopped, 0)) / free)::DOUBLE AS level FROM by_room),
level AS (SELECT arg_min(level, coalesce(stopped, 0)) AS level FROM levels WHERE NOT level * weight > {stop} * source_size),
shares AS (
  SELECT source, source_size,
         CASE WHEN level * weight > {stop} * source_size THEN ({stop} * source_size)::DOUBLE ELSE level * weight END AS target
  FROM sources, level),
placed AS (
  SELECT r, doc_id, size, source_size, target,
         coalesce(sum(size) OVER (PARTITION BY sized.source ORDER BY o, doc_id, size, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS place
  FROM sized JOIN shares ON sized.source IS NOT DISTINCT FROM shares.source),
mixed AS (SELECT doc_id, size, source_size, target, ({taken})::BIGINT AS taken, floor(target)::BIGINT AS budget, place FROM placed)
SELECT doc_id, size, source_size, target, taken,
       CASE WHEN size = 0 THEN 0 ELSE ({' + '.join(f'(budget > {e} * source_size + place)::INT' for e in range(stop))}) END::BIGINT AS copies
FROM mixed"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_license_scan": license_sql(),
        "op3_ngram_jaccard": jaccard_sql(),
        "op4_decontamination": contamination_sql(),
        "op7_quality": quality_sql(),
        "op8_chat_format": chat_sql(),
        "op9_warc": warc_sql(),
        "op11_ranked_search": search_sql(),
        "op12_prefix_trie": trie_sql(),
        "op13_mixing": mixing_sql(),
    }
