"""Lookup in a sorted table of intervals, row by row: constant arrays and a binary search."""

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _constant(values: Iterable, kind: str) -> Column:
    """A constant array, folded to one literal; values hold no comma."""
    return F.split(F.lit(",".join(str(v) for v in values)), ",").cast(f"array<{kind}>")


def interval_of(key: Column, table: Sequence[tuple], **kinds: str) -> Column:
    """Struct of the values of the interval that holds ``key``, null if none does.

    ``table`` has rows ``(low, high, *values)`` of whole numbers below 2^31, sorted and without
    overlaps; ``kinds`` names the values and their types. Every step of the search settles one bit
    of the interval's place, so a thousand intervals take ten steps. ``key`` occurs more than once
    in the result, so it should be a plain column or a lambda's variable.
    """
    if not table:
        return F.lit(None).cast(f"struct<{','.join(f'{n}:{k}' for n, k in kinds.items())}>")
    low, high, *values = zip(*table, strict=True)
    lows, highs = _constant(low, "int"), _constant(high, "int")
    named = [(_constant(v, kind), name) for v, (name, kind) in zip(values, kinds.items(), strict=True)]
    steps = F.array(*[F.lit(1 << n) for n in reversed(range(len(table).bit_length()))])
    # the last interval that begins at or before the key; beyond the ends there is none
    at = F.aggregate(steps, F.lit(-1), lambda a, step: F.when(F.get(lows, a + step) <= key, a + step).otherwise(a))
    return F.transform(F.array(at), lambda i: F.when(
        F.get(highs, i) >= key, F.struct(*[F.get(v, i).alias(name) for v, name in named])
    ))[0]
