"""Files in the shared folder that tasks write and read themselves."""

from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactloom.sources.shared import shared_table

#: Bits of an id that a round of the search for crowded ranges settles.
ROUND_BITS = 6
#: Tasks that write shards at most; a task writes its shards one after another.
MOST_TASKS = 20_000


def id_borders(sizes: DataFrame, shard_bytes: int) -> list[int]:
    """The smallest id of every shard, for a stored ``(id, size)`` table: ranges of about ``shard_bytes``.

    The bytes of ranges of equal width are summed, and ranges that hold more than a shard are cut into
    narrower ones, until each is at most a shard or a single id. What comes to the driver are a few
    dozen sums for each shard, wherever the ids lie.
    """
    low, high = sizes.agg(F.min("id"), F.max("id")).first()
    if low is None:
        return []
    shift = 0
    while (high >> shift) - (low >> shift) >= 1 << ROUND_BITS:
        shift += ROUND_BITS
    ranges, rows = [], sizes.filter(F.col("id").isNotNull())
    while True:
        sums = rows.groupBy(F.shiftright("id", shift).alias("at")).agg(F.sum("size").alias("size")).collect()
        crowded = [r["at"] for r in sums if r["size"] > shard_bytes and shift]
        ranges += [(r["at"] << shift, r["size"]) for r in sums if r["size"] <= shard_bytes or not shift]
        if not crowded:
            break
        table = sizes.sparkSession.createDataFrame([(at,) for at in crowded], "crowded long")
        rows = sizes.join(F.broadcast(table), F.shiftright("id", shift) == F.col("crowded"), "left_semi")
        shift -= ROUND_BITS
    borders, held = [], 0
    for start, size in sorted(ranges):
        if not borders or held + size > shard_bytes:
            borders.append(start)
            held = 0
        held += size
    return borders


def id_shards(df: DataFrame, id_col: str, size: Column, shard_bytes: int, tie: Column) -> tuple[Column, int]:
    """A shard number for each row and how many tasks should write them.

    Shards are ranges of whole-number ids, from 0 on, with about ``shard_bytes`` each, whatever the ids'
    spread is; only a single id with more makes a longer one, which is written as a stream all the same.
    Rows without an id are dealt by ``tie`` to shards of their own, with negative numbers.
    """
    sizes = shared_table(df.select(F.col(id_col).cast("long").alias("id"), (size + 16).cast("long").alias("size")), "shard-sizes")
    borders = id_borders(sizes, shard_bytes)
    unnamed = -(-(sizes.filter("id IS NULL").agg(F.sum("size")).first()[0] or 0) // shard_bytes)
    last = F.lit(0)
    if len(borders) > 1:
        starts = F.split(F.lit(",".join(map(str, borders))), ",").cast("array<bigint>")  # folded to one literal
        steps = F.array(*[F.lit(1 << n) for n in reversed(range(len(borders).bit_length()))])
        last = F.aggregate(
            steps, F.lit(0), lambda at, step: F.when(F.get(starts, at + step) <= F.col(id_col).cast("long"), at + step).otherwise(at)
        )
    dealt = -1 - F.pmod(F.xxhash64(tie), F.lit(max(1, unnamed)))
    shard = F.when(F.col(id_col).isNull(), dealt).otherwise(last).cast("long")
    parallel = df.sparkSession.sparkContext.defaultParallelism
    return shard, min(MOST_TASKS, max(len(borders) + unnamed, parallel))


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder: local paths, ``file:`` and whatever pyarrow knows by scheme."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def settle(folder: str, temporary: str, final: str, size: int) -> None:
    """Give a finished file its final name; a second try finds it there and is content.

    Tasks may run more than once, also at the same time: any of them may have moved the file.
    """
    system, base = opened(folder)
    try:
        system.move(f"{base}/{temporary}", f"{base}/{final}")
    except OSError:
        found = system.get_file_info(f"{base}/{final}")
        if found.type != fs.FileType.File or found.size != size:
            raise
