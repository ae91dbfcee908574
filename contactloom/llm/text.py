"""Column expressions for words and for values used more than once."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What separates words of letters and digits, once A-Z are lower case. Other code points are word characters.
NON_ALNUM = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: The same before A-Z are lowered.
NON_ALNUM_ANY_CASE = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
#: ASCII white space, which separates words in the wider sense.
SPACES = "[\\x20\\x09-\\x0D]+"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, join: Callable[[Column, Column], Column], zero: Column, block: int = 32, levels: int = 3) -> Column:
    """Of every element of an array, ``join`` over the elements before it (``zero`` for the first).

    ``join`` is associative. An array that grows by one in a fold is copied at every step, so only
    short blocks are folded; their totals are run over in turn.
    """
    def fold(a: Column) -> Column:
        grown = F.aggregate(a, F.array(zero), lambda acc, x: F.concat(acc, F.array(join(F.element_at(acc, -1), x))))
        return grown  # one longer than a; the last is the total

    def in_blocks(a: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(a) - 1) / block).cast("int"))
        blocks = F.transform(starts, lambda b: fold(F.slice(a, b * block + 1, block)))
        return let(blocks, moved)

    def moved(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.element_at(b, -1))
        return let(
            running(totals, join, zero, block, levels - 1),
            lambda before: F.flatten(F.transform(blocks, lambda b, i: F.transform(
                F.slice(b, F.lit(1), F.size(b) - 1), lambda x: join(F.get(before, i), x)
            ))),
        )

    if not levels:
        return let(fold(values), lambda grown: F.slice(grown, F.lit(1), F.size(grown) - 1))
    return let(values, lambda a: F.when(F.size(a) <= block, let(
        fold(a), lambda grown: F.slice(grown, F.lit(1), F.size(grown) - 1)
    )).otherwise(in_blocks(a)))


def whole(text: Column) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z to lower case and nothing else; texts that are all ASCII take the faster function."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER)
    )


def _cut(text: Column, separator: str) -> Column:
    return F.array_remove(F.split(text, separator), "")


def alnum_words(text: Column) -> Column:
    """Lower-cased words of letters, digits and everything beyond ASCII; none for a null text."""
    return _cut(ascii_lower(whole(text)), NON_ALNUM)


def alnum_word_count(text: Column) -> Column:
    """``size(alnum_words(text))`` without lowering the text."""
    return F.size(_cut(whole(text), NON_ALNUM_ANY_CASE))


def spaced_words(text: Column) -> Column:
    """Words between ASCII white space, case kept; none for a null text."""
    return _cut(whole(text), SPACES)


def row_key(id_col: str, text_col: str) -> list[Column]:
    """Names a row by its id and text, so that repeated and null ids join with their own rows."""
    return [F.col(id_col).alias("_id"), F.xxhash64(id_col, text_col).alias("_row")]


def boxed(df: DataFrame, **beside: Column) -> DataFrame:
    """The rows of ``df`` as one struct ``_r`` beside further columns, so that no name of theirs can clash.

    ``select("_r.*")`` gives the rows back.
    """
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_r"), *[c.alias(n) for n, c in beside.items()])
