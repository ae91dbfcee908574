"""Column expressions that read HTML with regular expressions only.

Every expression is linear in the page: an unclosed comment, script or tag runs to the end of the
page, as it does for a browser.
"""

from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

from contactloom.functions.fixed_values import BLOCK_TAGS, NAMED_ENTITIES, SEPARATOR_TAGS

BLOCK_MARK = "\u0001"  # between text blocks
HREF_MARK = "\u0002"  # between hrefs

INVISIBLE = (
    r"(?is)<(?=[!st])(?:!--.*?(?:-->|\z)|script\b.*?(?:</script\s*>|\z)"
    r"|style\b.*?(?:</style\s*>|\z)|title\b.*?(?:</title\s*>|\z))"
)
# The rest of a tag. A quote opens a value after '=' only, and may hold '>'; one that is never closed is
# a character like others. Every repetition of a group is possessive, so the matcher neither backtracks nor
# recurses; those of one class of characters inside are greedy, since Java has a faster loop for these: what
# follows them is the group's end or a character outside the class, so giving characters back never helps.
_VALUE = r"""=\s*+(?:"[^"]*"|'[^']*')?+"""
_REST = rf"(?:[^>=]+|{_VALUE})*+(?:>|\z)"
_BLOCK_NAMES = sorted(BLOCK_TAGS + SEPARATOR_TAGS)
# told by their first letter, so that a tag is not compared with every name
_BY_LETTER = [f"{c}(?:{'|'.join(name[1:] for name in names)})" for c, names in groupby(_BLOCK_NAMES, lambda name: name[0])]
WHOLE_BLOCK_TAG = rf"(?i)</?(?:{'|'.join(_BY_LETTER)})\b{_REST}"
WHOLE_TAG = rf"<[a-zA-Z/!?]{_REST}"
WHOLE_HREF = (
    rf"(?i)<a\b(?:[^>=\s]+|\s(?!href\s*+=)|{_VALUE})*+"
    rf"""(?:\shref\s*+=\s*+("[^"]*"|'[^']*'|[^\s"'>]+))?+{_REST}"""
)
_NAMED = f"&(?:{'|'.join(name[1:-1] for name in NAMED_ENTITIES)});"


def visible_html(html: Column) -> Column:
    """HTML without comments, scripts, styles and the title."""
    return F.regexp_replace(html, INVISIBLE, "")


def _entity_char(reference: Column) -> Column:
    """Character of ``65`` or ``x41``; a code that is no printable character gives U+FFFD, however long it is."""
    code = F.when(F.length(reference) <= 7, F.when(
        reference.rlike("^[xX]"), F.conv(F.substring(reference, 2, 6), 16, 10)
    ).otherwise(reference).cast("int"))
    printable = code.isin(9, 10, 13) | code.between(32, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    return F.when(
        printable, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    ).otherwise("�")


def _decode_piece(encoded: Column, i: Column) -> Column:
    """A text after ``&#`` with the reference it begins with decoded; leading zeros don't count."""
    piece = F.when(i == 0, encoded).otherwise(F.regexp_replace(encoded, "^([xX]?)0+(?=[0-9a-fA-F])", "$1"))
    reference = F.regexp_extract(piece, r"^([0-9]++|[xX][0-9a-fA-F]++);?", 1)
    rest = F.regexp_replace(piece, r"^(?:[0-9]++|[xX][0-9a-fA-F]++);?", "")
    return (
        F.when(i == 0, piece)
        .when(reference == "", F.concat(F.lit("&#"), encoded))
        .otherwise(F.concat(_entity_char(reference), rest))
    )


def decode_entities(text: Column) -> Column:
    """Decode numeric entities and those named ones that matter to numbers and links.

    ``text`` occurs several times in the result, so it should be a plain column.
    """
    decoded = F.when(
        text.contains("&#"), F.array_join(F.transform(F.split(text, "&#"), _decode_piece), "")
    ).otherwise(text)
    for name, char in NAMED_ENTITIES.items():
        decoded = F.replace(decoded, F.lit(name), F.lit(char))
    # names are looked for one by one only where there may be one
    ampersands = [F.replace(t, F.lit("&amp;"), F.lit("&")) for t in (decoded, text)]
    any_name = text.contains("&#") | text.rlike(_NAMED)
    return F.when(~text.contains("&"), text).when(any_name, ampersands[0]).otherwise(ampersands[1])


def marked_text(visible: Column) -> Column:
    """Text of visible HTML with ``BLOCK_MARK`` between blocks; inline tags join their text.

    Entities are still encoded.
    """
    return F.regexp_replace(F.regexp_replace(visible, WHOLE_BLOCK_TAG, BLOCK_MARK), WHOLE_TAG, "")


def blocks(text: Column) -> Column:
    return F.split(text, BLOCK_MARK)


def digit_text(marked: Column) -> Column:
    """``marked_text`` decoded, without the blocks that can't hold a number where there is anything to decode.

    Every valid number has ten digits, three of them in a row; a shorter block, and one that has no
    three and no encoded character either, need not be decoded.
    """
    kept = F.filter(blocks(marked), lambda b: (F.length(b) >= 10) & (b.rlike(r"\p{Nd}{3}") | b.contains("&#")))
    decoded = F.transform(F.array(F.concat_ws(BLOCK_MARK, kept)), lambda t: decode_entities(t))[0]
    return F.when(marked.contains("&"), decoded).otherwise(marked)


def quoted_hrefs(visible: Column) -> Column:
    """``<a href>`` values as they are written, quotes included."""
    return F.array_remove(F.regexp_extract_all(visible, F.lit(WHOLE_HREF), F.lit(1)), "")


def unquoted(href: Column) -> Column:
    """One of ``quoted_hrefs`` without its quotes: it has two or none."""
    return F.when(href.startswith('"') | href.startswith("'"), F.substring(href, F.lit(2), F.length(href) - 2)).otherwise(href)


def hrefs(quoted: Column) -> Column:
    """``quoted_hrefs`` in document order, without quotes, decoded."""
    return F.transform(F.transform(quoted, unquoted), lambda h: decode_entities(h))


def tel_hrefs(hrefs: Column) -> Column:
    return F.filter(hrefs, lambda h: h.startswith("tel:"))


def likely_tel_hrefs(quoted: Column) -> Column:
    """Those of ``hrefs`` that may be ``tel:`` links, and maybe an empty text; only these are decoded, all at once.

    A letter is encoded by a number only, so a link without ``tel`` and without ``&#`` is none.
    """
    likely = F.filter(F.transform(quoted, unquoted), lambda h: h.contains("tel") | h.contains("&#"))
    joined = F.transform(F.array(F.array_join(likely, HREF_MARK)), lambda t: decode_entities(t))[0]
    return F.split(joined, HREF_MARK)
