"""Elements of an HTML page and their whole text, nested ones included.

A page's text is one string, and an element's own ``string()`` is a stretch of it, so elements are
``(start, end)`` pairs over one text however deep they lie in each other. Spark cuts the page into tags and
decoded pieces of text; a machine with a stack goes once over the tags, in Arrow batches: a start tag first
closes what it ends implicitly (an open ``p`` before a block, an open ``li`` before the next one), an end tag
closes the nearest element of its name and all inside it, unless a stronger element stands between, and the
page's end closes the rest. Tags that neither carry text blocks nor structure (``a``, ``b``, ...) are no
elements here; their text joins.

The work is linear in the tags: the stack holds ``MAX_DEPTH`` elements, and what is nested deeper is part
of its ancestor.
"""

import re
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from contactloom.functions import html, phone

# Workers get the machine by value: they need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# --- fixed values: tags whose elements are text of their own ------------------------------------
TEXT_TAGS = [
    "p", "span", "div", "li", "strong", "em", "footer", "section", "header", "aside", "blockquote",
    "address", "nav", "small", "article", "h1", "h2", "h3", "h4", "h5", "h6",
]
# --- fixed values: further tags that give a page its structure ------------------------------------
STRUCTURE_TAGS = [
    "html", "body", "main", "form", "ul", "ol", "dl", "dt", "dd", "table", "thead", "tbody", "tfoot", "tr", "td", "th",
]
# --- fixed values: what a start tag closes if it is innermost; a p is closed by every block --------
_BLOCKS = [t for t in TEXT_TAGS + STRUCTURE_TAGS if t not in ("span", "strong", "em", "small", "html", "body")]
CLOSES = {
    "li": ["p", "li"], "dt": ["p", "dt", "dd"], "dd": ["p", "dt", "dd"], "td": ["p", "td", "th"], "th": ["p", "td", "th"],
    "tr": ["p", "td", "th", "tr"], "tbody": ["p", "td", "th", "tr", "thead", "tbody"],
    "tfoot": ["p", "td", "th", "tr", "thead", "tbody"],
}
# --- fixed values: end tags of weaker elements do not reach through stronger ones -------------------
STRENGTH = {
    "div": 2, "td": 3, "th": 3, "tr": 4, "thead": 5, "tbody": 5, "tfoot": 5, "table": 6, "body": 7, "html": 8,
}
MAX_DEPTH = 255
BLOCK = 32

_ELEMENT = "ord:int,tag:string,start:int,end:int,parent:int"
_PAGE = f"struct<text:string,elements:array<struct<{_ELEMENT},around_start:int,around_end:int>>>"
_WANTED = re.compile(rf"</?(?:{'|'.join(TEXT_TAGS + STRUCTURE_TAGS)})(?![a-zA-Z0-9])", re.ASCII | re.IGNORECASE)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def _running(lengths: Column) -> Column:
    """Sums of the numbers before each one and, last, of all; in blocks, like the elements."""
    starts = F.sequence(F.lit(0), F.floor(F.size(lengths) / BLOCK).cast("int"))

    def fold(a: Column, first: Column) -> Column:
        return F.aggregate(a, F.array(first), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    def in_blocks(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x))
        return let(fold(totals, F.lit(0)), lambda before: F.concat(F.flatten(F.transform(
            blocks, lambda b, i: F.slice(fold(b, F.get(before, i)), F.lit(1), F.size(b))
        )), F.array(F.element_at(before, -1))))

    return let(lengths, lambda a: let(F.transform(starts, lambda s: F.slice(a, s * BLOCK + 1, F.lit(BLOCK))), in_blocks))


def _event(tag: str) -> tuple | None:
    """``(name, strength, opens, closes)`` of a tag; ``closes`` is None for an end tag. None if it is no element's."""
    found = _WANTED.match(tag)
    if not found:
        return None
    name = found.group().strip("</").lower()
    closes = None if tag.startswith("</") else frozenset(CLOSES.get(name, ["p"] if name in _BLOCKS else []))
    return name, STRENGTH.get(name, 1), closes is not None and not tag.endswith("/>"), closes


def _after_end(stack: list[tuple], name: str, strength: int) -> int:
    """How many elements stay open after an end tag."""
    for at in range(len(stack) - 1, -1, -1):
        if stack[at][0] == name:
            return at
        if stack[at][1] > strength:
            break
    return len(stack)


def _work_off(events: list, places: list[int], length: int, out: tuple[list, ...]) -> None:
    """One page's elements onto the lists of ``out``: ord, name, start, end, and the place of the element around."""
    ords, tags, starts, ends, above = out
    stack: list[tuple] = []  # (name, strength, place in the lists)
    beyond = ord_ = 0
    for event, at in zip(events, places, strict=True):
        if event is None:
            continue
        name, strength, opens, closes = event
        keeps = len(stack)
        if closes is None:
            if beyond:
                beyond -= 1
            else:
                keeps = _after_end(stack, name, strength)
        elif closes:
            while keeps and stack[keeps - 1][0] in closes:
                keeps -= 1
        for _, _, place in stack[keeps:]:
            ends[place] = at
        del stack[keeps:]
        if opens and keeps >= MAX_DEPTH:
            beyond += 1
        elif opens:
            above.append(stack[-1][2] if stack else -1)
            stack.append((name, strength, len(ords)))
            ords.append(ord_)
            tags.append(name)
            starts.append(at)
            ends.append(length)
        ord_ += 1


def _read_pages(tags: pa.Array, pieces: pa.Array) -> pa.Array:
    """``_PAGE`` of pages given as their tags and the pieces of text before, between and behind them."""
    told = tags.flatten().dictionary_encode()
    kinds = [_event(tag) for tag in told.dictionary.to_pylist()]
    codes = told.indices.to_numpy(zero_copy_only=False)
    lengths = pc.utf8_length(pieces.flatten()).to_numpy(zero_copy_only=False).astype(np.int64)
    n_pieces = pc.fill_null(pc.list_value_length(pieces), 0).to_numpy(zero_copy_only=False)
    out: tuple[list, ...] = ([], [], [], [], [])
    offsets, tag_at, piece_at = [0], 0, 0
    n_tags = pc.fill_null(pc.list_value_length(tags), 0).to_pylist()
    for n, n_own in zip(n_pieces.tolist(), n_tags, strict=True):
        if n:
            places = np.cumsum(lengths[piece_at : piece_at + n]).tolist()
            events = [kinds[c] for c in codes[tag_at : tag_at + n_own].tolist()]
            _work_off(events, places[:-1], places[-1], out)
        offsets.append(len(out[0]))
        tag_at, piece_at = tag_at + n_own, piece_at + n
    ords, names, starts, ends, above = out
    start, end, parent = np.array(starts, np.int32), np.array(ends, np.int32), np.array(above, np.int64)
    ord_, inner = np.array(ords, np.int32), parent >= 0
    text = pc.binary_join(pieces.cast(pa.list_(pa.string())), "")
    whole = np.repeat(pc.fill_null(pc.utf8_length(text), 0).to_numpy(zero_copy_only=False), np.diff(offsets)).astype(np.int32)
    columns = {
        "ord": ord_, "tag": pa.array(names, pa.string()), "start": start, "end": end,
        "parent": np.where(inner, ord_[parent], np.int32(-1)) if len(ords) else ord_,
        "around_start": np.where(inner, start[parent], np.int32(0)) if len(ords) else ord_,
        "around_end": np.where(inner, end[parent], whole) if len(ords) else ord_,
    }
    elements = pa.StructArray.from_arrays([pa.array(c) for c in columns.values()], list(columns))
    valid = pc.is_valid(pieces)
    listed = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), elements, mask=pc.invert(valid))
    return pa.StructArray.from_arrays([text, listed], ["text", "elements"])


def page_elements(visible: Column) -> Column:
    """``text_and_elements`` whose elements also have ``around_start`` and ``around_end``.

    They are the stretch of the element around, of the whole page if there is none.
    """
    tags = F.regexp_extract_all(visible, F.lit(html.WHOLE_TAG), F.lit(0))
    plain = F.split(visible, html.WHOLE_TAG)
    decoded = F.transform(plain, lambda t: html.decode_entities(t))
    return F.arrow_udf(_read_pages, _PAGE)(tags, F.when(visible.contains("&"), decoded).otherwise(plain))


def text_and_elements(visible: Column) -> Column:
    """Struct of a page's ``text``, decoded, and its ``elements`` in document order.

    Elements are ``(ord, tag, start, end, parent)``; ``parent`` is the ``ord`` of the element around, -1 if
    there is none. ``visible`` is the page without comments, scripts, styles and title.
    """
    page = page_elements(visible)
    own = F.transform(page["elements"], lambda e: F.struct(*[e[f.split(":")[0]] for f in _ELEMENT.split(",")]))
    return F.struct(page["text"].alias("text"), own.alias("elements"))


def is_text_tag(element: Column) -> Column:
    return element["tag"].isin(TEXT_TAGS)


def text_of(text: Column, element: Column) -> Column:
    return F.substring(text, element["start"] + 1, element["end"] - element["start"])


def runs_of_elements(page: Column) -> Column:
    """Of every text element, in document order, the digit runs of its text joined by ``RUN_GAP``.

    ``page`` is as of ``text_and_elements``. The runs are found once in the whole text; an element has
    the part of each that lies inside it. Elements without a run are left out, equal ones given once.
    """
    def of_runs(runs: Column) -> Column:
        def inside(element: Column) -> Column:
            held = F.filter(runs, lambda r: (r["start"] < element["end"]) & (r["end"] > element["start"]))
            return F.array_join(F.transform(held, lambda r: let(
                F.greatest(element["start"] - r["start"], F.lit(0)),
                lambda cut: F.substring(r["run"], cut + 1, F.least(r["end"], element["end"]) - r["start"] - cut),
            )), phone.RUN_GAP)

        return F.array_remove(F.array_distinct(F.transform(F.filter(page["elements"], is_text_tag), inside)), "")

    found = F.regexp_extract_all(page["text"], F.lit(phone.DIGIT_RUN), F.lit(0))
    gaps = F.split(page["text"], phone.DIGIT_RUN)

    def placed(matches: Column) -> Column:
        def at(gaps: Column) -> Column:
            lengths = F.transform(matches, lambda m, i: F.char_length(F.get(gaps, i)) + F.char_length(m))
            return let(_running(lengths), lambda ends: F.transform(matches, lambda m, i: F.struct(
                m.alias("run"), (F.get(ends, i + 1) - F.char_length(m)).alias("start"), F.get(ends, i + 1).alias("end"),
            )))

        return let(gaps, at)

    none = F.array().cast("array<string>")
    return let(found, lambda m: F.when(F.size(m) == 0, none).otherwise(let(placed(m), of_runs)))
