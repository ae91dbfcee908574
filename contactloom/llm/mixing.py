"""Mixing sources to target weights along a time-varying curriculum.

Every source has a target of words and a weight schedule over training time ``t`` from 0 to 1. A
source's documents form a stream, in an order that a hash of id and text gives, repeated as often
as the target asks. The schedule is integrated to the source's cumulative demand of words; the
place of a document's first word in its stream, put into the inverse of that demand, is the time
at which it is due. The mix is the range-sort of all copies by that time.

Targets share all words by weight; a target stops at ``MAX_EPOCHS`` times its source's size, and
what is above goes to the others by weight until none is above. So with ``level`` words per unit
of weight a target is ``min(MAX_EPOCHS * size, level * weight)``; the level comes from rounds of
one aggregate over the sources. A source gives exactly the whole words of its target: its last
copy is cut at the target, so ``words`` of one copy per source may be less than the document's size.

Places in a stream are prefix sums in two steps, over ranges of the hash and then inside a range,
so a source with a third of all documents is worked on in as many ranges. Ranks of sources are
counted per range of a range-sort. Texts stay in the scan; what is shuffled are ids, sizes and hashes.

Defined cases: null and blank texts have size 0 and are never taken; rows without a source are one
source, the last one; null ids are ids like others; rows that repeat id, source and text are
documents of their own, side by side in the stream; an empty table, or one without words, gives
targets of 0 and an empty mix; other columns are ignored.
"""

from collections.abc import Mapping, Sequence
from itertools import pairwise

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactloom.llm.text import spaced_words
from contactloom.sources.shared import shared_table

MAX_EPOCHS = 3
WEIGHTS = (1, 2, 3)
#: Documents of all sources together in one range of the hash, about.
RANGE_ROWS = 50_000

Knots = Sequence[tuple[float, float]]
#: Weight over time by class of weight, as knots ``(t, weight)`` joined by straight lines: light
#: sources fade, heavy ones rise.
SCHEDULES: Mapping[int, Knots] = {
    1: ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)),
    2: ((0.0, 1.0), (1.0, 1.0)),
    3: ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)),
}


def integrated(knots: Knots) -> list[tuple[float, float, float, float, float]]:
    """Segments ``(t, width, from, to, area before)`` of a schedule, scaled to an area of 1."""
    times = [t for t, _ in knots]
    if times[0] != 0 or times[-1] != 1 or sorted(set(times)) != times or min(v for _, v in knots) < 0:
        raise ValueError("a schedule has knots at rising times from 0 to 1 and no negative weight")
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in pairwise(knots))
    if not area:
        raise ValueError("a schedule needs some weight")
    segments, before = [], 0.0
    for (t0, v0), (t1, v1) in pairwise(knots):
        segments.append((t0, t1 - t0, v0 / area, v1 / area, before))
        before += (t1 - t0) * (v0 + v1) / 2 / area
    return segments


def due(share: Column, knots: Knots) -> Column:
    """The time at which a source has given ``share`` of its target: the inverse of its integrated schedule."""
    inverse = None
    for t, width, start, end, before in integrated(knots):
        rest = F.greatest(share - before, F.lit(0.0))
        # the root of start * x + (end - start) / (2 * width) * x * x = rest that is stable for flat lines too
        root = F.sqrt(F.greatest(F.lit(start * start) + rest * (2 * (end - start) / width), F.lit(0.0)))
        inside = F.when(rest > 0, F.lit(t) + F.least(rest * 2 / (root + start), F.lit(width))).otherwise(F.lit(t))
        inverse = inside if inverse is None else F.when(share >= before, inside).otherwise(inverse)
    return inverse


def given(t: Column, knots: Knots) -> Column:
    """The share of its target that a source has given at time ``t``."""
    total = F.lit(0.0)
    for t0, width, start, end, _ in integrated(knots):
        x = F.least(F.greatest(t - t0, F.lit(0.0)), F.lit(width))
        total = total + x * start + x * x * ((end - start) / (2 * width))
    return total


def sized(docs: DataFrame, text: str = "text", source: str = "source", id_col: str = "doc_id", seed: int = 0) -> DataFrame:
    """``(id, source, size, order, times)``: distinct documents and how many rows each has; stored."""
    order = F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.col(id_col).cast("string"), F.col(text)).cast("binary"))
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(source).cast("string").alias("source"),
        F.size(spaced_words(F.col(text))).cast("long").alias("size"), order.alias("order"),
    )
    counted = rows.groupBy("id", "source", "size", "order").agg(F.count(F.lit(1)).alias("times"))
    return shared_table(counted, "mix-documents")


def ranked_sources(documents: DataFrame) -> DataFrame:
    """``(source, source_size, weight)``; ranks are counted per range of a range-sort, nulls last."""
    last = F.col("source").isNull().alias("last")
    sizes = documents.groupBy("source").agg(F.sum(F.col("size") * F.col("times")).alias("source_size"))
    dealt = shared_table(
        sizes.repartitionByRange(last, "source").withColumn("part", F.spark_partition_id()), "mix-sources"
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")
    )
    place = F.row_number().over(Window.partitionBy("part").orderBy(last, "source")) - 1
    chosen = F.array(*[F.lit(w) for w in WEIGHTS])
    rank = F.col("start") + F.col("place")
    return dealt.withColumn("place", place).join(starts, "part").select(
        "source", "source_size", F.get(chosen, (rank % len(WEIGHTS)).cast("int")).alias("weight")
    )


def targets(sources: DataFrame) -> DataFrame:
    """``sources`` with ``target``, in words. Every round is one aggregate over the sources."""
    stop = F.col("source_size") * MAX_EPOCHS
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, None
    while True:
        above = F.lit(level) * F.col("weight") > stop if full is not None else F.lit(False)
        seen = sources.agg(
            F.count(F.when(above, 1)), F.coalesce(F.sum(F.when(above, stop)), F.lit(0)),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0)),
        ).first()
        if seen[0] == full or not seen[2]:
            break
        full, level = seen[0], (total - seen[1]) / seen[2]
    due_words = F.lit(level) * F.col("weight")
    return sources.withColumn("target", F.when(due_words > stop, stop.cast("double")).otherwise(due_words))


def streams(docs: DataFrame, text: str = "text", source: str = "source", id_col: str = "doc_id", seed: int = 0) -> DataFrame:
    """One row per row of ``docs``, stored: ``(row, id, source, size, source_size, weight, target, place)``.

    ``place`` is where the document begins in its source's stream, in words; ``row`` is a number of its own.
    """
    documents = sized(docs, text, source, id_col, seed)
    shares = targets(ranked_sources(documents))
    n_ranges = max(64, documents.count() // RANGE_ROWS)
    # of 32 bits of the hash, so ranges are in the order of the hash
    hashed = F.conv(F.substring("order", 1, 8), 16, 10).cast("long")
    dealt = documents.withColumn("range", F.floor(hashed * n_ranges / (1 << 32)).cast("int"))
    words = F.col("size") * F.col("times")
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = dealt.groupBy("source", "range").agg(F.sum(words).alias("words")).withColumn(
        "start", F.coalesce(F.sum("words").over(before), F.lit(0))
    )
    known = ranges.alias("r").join(shares.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source"))).select(
        F.col("r.source").alias("of"), F.col("range").alias("in_range"), "start", "source_size", "weight", "target"
    )
    inside = Window.partitionBy("source", "range").orderBy("order", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("inside", F.coalesce(F.sum(words).over(inside), F.lit(0))).join(
        known, F.col("source").eqNullSafe(F.col("of")) & (F.col("range") == F.col("in_range"))
    )
    every = placed.withColumn("same", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)))
    return shared_table(every.select(
        F.monotonically_increasing_id().alias("row"), "id", "source", "size", "source_size", "weight", "target",
        (F.col("start") + F.col("inside") + F.col("same") * F.col("size")).alias("place"),
    ), "mix-streams")


def mix(placed: DataFrame, schedules: Mapping[int, Knots] = SCHEDULES) -> DataFrame:
    """The copies the mix takes, in training order: ``(position, time, row, id, source, epoch, words)``.

    ``position`` is how many words all sources together have given by then, by their schedules.
    """
    budget = F.floor("target").cast("long")
    epochs = F.ceil(budget / F.greatest("source_size", F.lit(1))).cast("int")
    copies = placed.filter("size > 0").filter(epochs > 0).withColumn(
        "epoch", F.explode(F.sequence(F.lit(0), epochs - 1))
    ).withColumn("start", F.col("epoch") * F.col("source_size") + F.col("place"))
    taken = copies.withColumn("words", F.least(F.col("size"), budget - F.col("start"))).filter("words > 0")
    share = F.col("start") / F.nullif("target", F.lit(0.0))
    time = None
    for weight in WEIGHTS:
        own = due(share, schedules[weight])
        time = own if time is None else F.when(F.col("weight") == weight, own).otherwise(time)
    by_class = {r["weight"]: r["words"] for r in placed.groupBy("weight", "source").agg(
        F.first("target").alias("target")).groupBy("weight").agg(F.sum("target").alias("words")).collect()}
    position = F.lit(0.0)
    for weight, words in sorted(by_class.items()):
        position = position + given(F.col("time"), schedules[weight]) * words
    timed = taken.withColumn("time", time).withColumn("position", position)
    return timed.select("position", "time", "row", "id", "source", "epoch", "words").orderBy("position", "source", "epoch", "row")


def taken_words(placed: DataFrame, mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per row of the documents: what the mix takes of it, and when first."""
    told = mixed.groupBy("row").agg(
        F.sum("words").alias("taken"), F.count(F.lit(1)).alias("copies"), F.min("time").alias("first_time")
    )
    return placed.join(told, "row", "left").select(
        F.col("id").alias(id_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
        F.coalesce("copies", F.lit(0)).cast("long").alias("copies"), "first_time",
    )
