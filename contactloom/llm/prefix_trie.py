"""The trie of conversation prefixes: which conversations begin with the same turns, and what sharing them saves.

A node is a distinct sequence of first turns; the root is the empty one. It is named by its depth
and two 61-bit polynomial hashes of its turns' digests.

1. ``placed``: turns become digests and lengths, and get their place in their conversation from a
   range-sort over all turns, so a conversation with a third of all rows is spread as well.
2. ``paths``: places are cut into pieces of ``PIECE`` turns. A piece's hash can be put behind any
   other, so one streamed pass over the pieces' hashes gives every piece its start, and the pieces
   then hash their prefixes on their own.
3. ``sketch``: a count-min sketch of all prefix hashes, with counters that stop at two. Its width is
   four cells a prefix up to ``MAX_WIDTH``; a fuller one proves less and changes no result.
4. ``screened``: where the estimate is one, a prefix has one member, and so has everything behind
   it: that tail is emitted as one row, without a shuffle. Only what is before it, the prefixes that
   may be shared, is grouped exactly.
5. Sums over a subtree are sums over the members of its top: a conversation's owned nodes are those
   whose smallest member it is, they end its path, and the turns before them are the ones it saves.
   So two aggregates by prefix and one by conversation give all columns; nothing walks the tree.

A conversation that ends in a shared node is listed there in ascending order: ids are joined in
ranges of ``ID_RANGE``, the ranges of a node are streamed through one SHA-256, which no two tasks
could share.

Defined cases: null roles and texts are empty; null turns come first, equal turns by a digest of
role and text; rows that repeat are turns of their own; rows without a conversation's id are left
out; an empty table has no nodes, not even a root; other columns are ignored.
"""

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactloom.llm.shingles import mix
from contactloom.llm.text import whole
from contactloom.sources.shared import shared_table

PIECE = 256
SLICE_ROWS = 512  # pieces that are worked on at once
PRIME = (1 << 61) - 1
BASES = (0x0B5297A4D3C96E1F, 0x1A3D5E7F90B1C2D7)  # any two numbers below the prime
MIN_WIDTH, MAX_WIDTH = 1 << 16, 1 << 24
BLOCK = 1 << 16  # cells of a sketch that travel together
ID_RANGE = 4096
#: Nodes with more than this part of all children are looked up by broadcast; they are fewer than its inverse.
HOT_PART = 1e-4
KEY = ["depth", "d1", "d2"]


# --- turns to places ---------------------------------------------------------------------------


def digests(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """``(conv, given, turn, x1, x2, chars)``: two 60-bit parts of a digest of role and text."""
    who, said = whole(F.col(role)), whole(F.col(text))
    told = F.md5(F.concat(F.char_length(who).cast("string"), F.lit(":"), who, said).cast("binary"))
    part = lambda at: F.conv(F.substring("told", at, 15), 16, 10).cast("long")
    return turns.filter(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"), F.col(turn).isNotNull().alias("given"), F.col(turn).alias("turn"),
        told.alias("told"), F.char_length(said).cast("long").alias("chars"),
    ).select("conv", "given", "turn", part(1).alias("x1"), part(16).alias("x2"), "chars")


def _count_in_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the part's number and each row's place among the rows of its conversation there; rows are sorted."""
    part, last, seen = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        convs = batch.column(0).to_numpy()
        if not len(convs):
            continue
        first = np.concatenate([[True], convs[1:] != convs[:-1]])
        start = np.maximum.accumulate(np.where(first, np.arange(len(convs)), 0))
        place = np.arange(len(convs)) - start
        if last == convs[0]:
            place[convs == last] += seen
        last, seen = convs[-1], int(place[-1]) + 1
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(np.full(len(convs), part, np.int32)), pa.array(place), *(batch.column(c) for c in ("x1", "x2", "chars"))],
            names=["conv", "part", "place", "x1", "x2", "chars"],
        )


def placed(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """``(conv, place, x1, x2, chars)`` of every turn, ``place`` from 0.

    Conversations that go over the border of a part are the first or last of their parts, so
    what is counted for the offsets is at most two rows a part. Turns that are all the same may
    stand in any order, so a number of the row spreads them over parts.
    """
    order = ["conv", "given", "turn", "x1", "x2", "row"]
    rows = digests(turns, conv, turn, role, text).withColumn("row", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    counted = shared_table(rows.mapInArrow(
        _count_in_part, "conv long, part int, place long, x1 long, x2 long, chars long"
    ), "trie-turns")
    edges = counted.groupBy("part").agg(F.array(F.min("conv"), F.max("conv")).alias("c")).select(
        F.explode("c").alias("conv")).distinct()
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.join(F.broadcast(edges), "conv", "left_semi").groupBy("conv", "part").agg(
        F.max("place").alias("n")
    ).withColumn("before", F.sum(F.col("n") + 1).over(before)).filter("before > 0").select("conv", "part", "before")
    return counted.join(F.broadcast(offsets), ["conv", "part"], "left").select(
        "conv", (F.col("place") + F.coalesce("before", F.lit(0))).alias("place"), "x1", "x2", "chars"
    )


# --- prefix hashes -------------------------------------------------------------------------------


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(low, SLICE_ROWS)


def _hashed(state: tuple[int, int], xs1, xs2) -> Iterator[tuple[int, int]]:
    a, b = state
    for x, y in zip(xs1, xs2, strict=True):
        a = (a * BASES[0] + x + 1) % PRIME
        b = (b * BASES[1] + y + 1) % PRIME
        yield a, b


def _piece_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(conv, no, x1, x2, chars)`` of pieces -> ``(conv, no, n, h1, h2, chars)``."""
    for batch in _slices(batches):
        ends = []
        for x1, x2 in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            end = 0, 0
            for end in _hashed((0, 0), x1, x2):  # noqa: B007 - the last one counts
                pass
            ends.append(end)
        chars = [sum(c) for c in batch.column(4).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2).value_lengths().cast(pa.int64()),
             *(pa.array([e[i] for e in ends], pa.int64()) for i in (0, 1)), pa.array(chars, pa.int64())],
            names=["conv", "no", "n", "h1", "h2", "chars"],
        )


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces' hashes -> ``(conv, no, start, s1, s2, cum, last)``: what stands before each piece.

    A piece is told when its successor is seen, so that the last one of a conversation is known.
    """
    names = ["conv", "no", "start", "s1", "s2", "cum", "last"]
    types = [pa.int64()] * 6 + [pa.bool_()]
    held, state = None, None
    out = []

    def told():
        rows = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
        out.clear()
        return pa.RecordBatch.from_arrays(rows, names=names)

    for batch in batches:
        for conv, no, n, h1, h2, chars in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            same = held is not None and held[0] == conv
            if held is not None:
                out.append((*held, not same))
            start, a, b, cum = state if same else (0, 0, 0, 0)
            held = conv, no, start, a, b, cum
            state = (
                start + n, (a * pow(BASES[0], n, PRIME) + h1) % PRIME, (b * pow(BASES[1], n, PRIME) + h2) % PRIME, cum + chars,
            )
        if out:
            yield told()
    if held is not None:
        out.append((*held, True))
        yield told()


PATH = "conv long, start long, s1 long, s2 long, cum long, last boolean, d1 array<long>, d2 array<long>, chars array<long>"


def _prefix_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        conv, start, s1, s2, cum, last, x1, x2, chars = batch.columns
        found = [
            list(_hashed(s, a, b))
            for s, a, b in zip(zip(s1.to_pylist(), s2.to_pylist(), strict=True), x1.to_pylist(), x2.to_pylist(), strict=True)
        ]
        hashes = [pa.array([[d[i] for d in f] for f in found], pa.list_(pa.int64())) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays(
            [conv, start, s1, s2, cum, last, *hashes, chars],
            names=["conv", "start", "s1", "s2", "cum", "last", "d1", "d2", "chars"],
        )


def paths(turns: DataFrame, convs: DataFrame | None = None) -> DataFrame:
    """Pieces of all conversations with the hashes of their prefixes; stored.

    ``turns`` is ``(conv, place, x1, x2, chars)``; places of a conversation are distinct and may have
    gaps. ``convs`` lists further conversations, which have no turns.
    """
    pieces = turns.groupBy("conv", F.floor(F.col("place") / PIECE).alias("no")).agg(
        F.array_sort(F.collect_list(F.struct("place", "x1", "x2", "chars"))).alias("t")
    ).select("conv", "no", "t.x1", "t.x2", "t.chars")
    pieces = shared_table(pieces, "trie-pieces")
    ends = pieces.mapInArrow(_piece_hashes, "conv long, no long, n long, h1 long, h2 long, chars long")
    chain = ends.repartition("conv").sortWithinPartitions("conv", "no").mapInArrow(
        _chained, "conv long, no long, start long, s1 long, s2 long, cum long, last boolean"
    )
    found = pieces.join(chain, ["conv", "no"]).select("conv", "start", "s1", "s2", "cum", "last", "x1", "x2", "chars").mapInArrow(
        _prefix_hashes, PATH
    )
    if convs is not None:
        none = F.array().cast("array<long>")
        zero = F.lit(0).cast("long")
        turnless = convs.select("conv").distinct().join(pieces.select("conv").distinct(), "conv", "left_anti").select(
            "conv", *[zero.alias(c) for c in ("start", "s1", "s2", "cum")], F.lit(True).alias("last"),
            *[none.alias(c) for c in ("d1", "d2", "chars")],
        )
        found = found.unionByName(turnless)
    return shared_table(found, "trie-paths")


# --- the sketch ----------------------------------------------------------------------------------


def cells(d1: np.ndarray, d2: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each prefix in each row of the sketch."""
    return tuple((mix(d.view(np.uint64)) & np.uint64(width - 1)).astype(np.int64) for d in (d1, d2))


def _sketch_part(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Counters of a task's prefixes, in compressed blocks; blocks without a count stay away."""
    counts = np.zeros((2, width), np.uint8)
    for batch in batches:
        d1, d2 = (batch.column(c).flatten().to_numpy() for c in (0, 1))
        for row, at in zip(counts, cells(d1, d2, width), strict=True):
            places, times = np.unique(at, return_counts=True)
            row[places] = np.minimum(row[places] + np.minimum(times, 2), 2)
    blocks = counts.reshape(-1, BLOCK)
    for n in np.flatnonzero(blocks.any(axis=1)):
        yield pa.RecordBatch.from_arrays(
            [pa.array([n], pa.int32()), pa.array([zlib.compress(blocks[n].tobytes(), 1)], pa.binary())], names=["block", "counts"]
        )


def _sketch_sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of blocks sorted by number, as one bit a cell: counted twice or more."""
    at, total = None, None

    def told():
        bits = np.packbits(total >= 2).tobytes()
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([bits], pa.binary())], names=["block", "bits"])

    for batch in batches:
        for n, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if n != at:
                if at is not None:
                    yield told()
                at, total = n, np.zeros(BLOCK, np.uint8)
            total = np.minimum(total + np.frombuffer(zlib.decompress(data), np.uint8), 2)
    if at is not None:
        yield told()


def sketch_width(n: int) -> int:
    return min(MAX_WIDTH, max(MIN_WIDTH, 1 << (4 * max(n, 1) - 1).bit_length()))


def sketch(found: DataFrame, width: int) -> np.ndarray:
    """Two rows of packed bits: the cells that were counted more than once. At most ``MAX_WIDTH / 4`` bytes."""
    parts = found.select("d1", "d2").mapInArrow(lambda b: _sketch_part(b, width), "block int, counts binary")
    sums = parts.repartition("block").sortWithinPartitions("block").mapInArrow(_sketch_sum, "block int, bits binary")
    bits = np.zeros((2 * width // BLOCK, BLOCK // 8), np.uint8)
    for r in sums.collect():
        bits[r["block"]] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return bits.reshape(2, width // 8)


def maybe_shared(bits: np.ndarray, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
    """Whether the estimate of each prefix is above one."""
    at1, at2 = cells(d1, d2, bits.shape[1] * 8)
    return ((bits[0][at1 >> 3] >> (7 - (at1 & 7))) & (bits[1][at2 >> 3] >> (7 - (at2 & 7))) & 1).astype(bool)


SCREENED = (
    "conv long, start long, s1 long, s2 long, cum long, last boolean, n long, "
    "d1 array<long>, d2 array<long>, chars array<long>, cums array<long>, t1 long, t2 long, tail_cum long"
)


def _screen(batches: Iterator[pa.RecordBatch], bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Cuts every piece before its first proven singleton; ``t1, t2, tail_cum`` is what stands before the cut."""
    for batch in batches:
        conv, start, s1, s2, cum, last, d1, d2, chars = batch.columns
        ends = np.concatenate([[0], np.cumsum(d1.value_lengths().to_numpy())])
        flat = [c.flatten().to_numpy() for c in (d1, d2, chars)]
        shared = maybe_shared(bits, flat[0], flat[1])
        stops = np.flatnonzero(~shared)
        # of every piece the first place that is a singleton, else its end
        cut = np.append(stops, len(shared))[np.searchsorted(stops, ends[:-1])]
        cut = np.minimum(cut, ends[1:])
        sizes = cut - ends[:-1]
        keep = np.arange(len(shared)) < np.repeat(cut, np.diff(ends))
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
        sums = np.concatenate([[0], np.cumsum(flat[2])])
        flat.append(sums[1:] + np.repeat(cum.to_numpy() - sums[ends[:-1]], np.diff(ends)))
        before = np.maximum(cut - 1, 0)
        tops = [
            np.where(sizes > 0, f[before] if len(f) else 0, s.to_numpy()) for f, s in zip(flat[:2], (s1, s2), strict=True)
        ]
        yield pa.RecordBatch.from_arrays(
            [conv, start, s1, s2, cum, last, pa.array(np.diff(ends)),
             *(pa.ListArray.from_arrays(offsets, pa.array(f[keep])) for f in flat),
             *(pa.array(t, pa.int64()) for t in tops), pa.array(cum.to_numpy() + sums[cut] - sums[ends[:-1]])],
            names=["conv", "start", "s1", "s2", "cum", "last", "n", "d1", "d2", "chars", "cums", "t1", "t2", "tail_cum"],
        )


def screened(found: DataFrame) -> DataFrame:
    """``paths`` cut to the prefixes that may be shared, and what the tail needs; stored."""
    n = found.agg(F.sum(F.size("d1"))).first()[0] or 0
    bits = found.sparkSession.sparkContext.broadcast(sketch(found, sketch_width(n)))
    return shared_table(found.mapInArrow(lambda b: _screen(b, bits.value), SCREENED), "trie-screened")


# --- nodes ---------------------------------------------------------------------------------------


def members(cut: DataFrame, *more: str) -> DataFrame:
    """One row per conversation and prefix that may be shared: ``KEY``, the parent's hashes, ``chars``, ``cum``, ``ends``.

    ``cum`` is the code points of all turns up to the prefix's last; the root is everyone's first.
    """
    def before(hashes: str, start: str, i: Column) -> Column:
        return F.when(i == 0, F.col(start)).otherwise(F.get(F.col(hashes), i - 1))

    own = F.transform("d1", lambda d, i: F.struct(
        (F.col("start") + i + 1).alias("depth"), d.alias("d1"), F.get("d2", i).alias("d2"),
        before("d1", "s1", i).alias("p1"), before("d2", "s2", i).alias("p2"), F.get("chars", i).alias("chars"),
        F.get("cums", i).alias("cum"), (F.col("last") & (i + 1 == F.col("n"))).alias("ends"),
    ))
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = F.struct(
        zero.alias("depth"), zero.alias("d1"), zero.alias("d2"), none.alias("p1"), none.alias("p2"),
        zero.alias("chars"), zero.alias("cum"), (F.col("last") & (F.col("n") == 0)).alias("ends"),
    )
    every = F.when(F.col("start") == 0, F.concat(F.array(root), own)).otherwise(own)
    return cut.select("conv", *more, F.inline(every))


def shared_nodes(cut: DataFrame) -> DataFrame:
    """``KEY, n_convs, conv, p1, p2, chars, cum`` of every prefix that may be shared, counted exactly; stored."""
    return shared_table(members(cut).groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n_convs"), F.min("conv").alias("conv"),
        *[F.min(c).alias(c) for c in ("p1", "p2", "chars", "cum")],
    ), "trie-shared")


def tails(cut: DataFrame) -> DataFrame:
    """``(conv, first, end, last, KEY of the node before, tail_cum)`` of the pieces with a proven singleton."""
    first = F.col("start") + F.size("d1")
    return cut.filter(F.size("d1") < F.col("n")).select(
        "conv", first.alias("depth"), F.col("t1").alias("d1"), F.col("t2").alias("d2"), (first + 1).alias("first"),
        (F.col("start") + F.col("n")).alias("end"), "last", "tail_cum",
    )


def conversation_facts(cut: DataFrame, nodes: DataFrame, leaves: DataFrame) -> DataFrame:
    """``(conv, owns, owns_cum, leaf)``: the depth from which a conversation owns its nodes, the code
    points before that, and whether its end is a leaf of its own; stored."""
    no = F.lit(0)
    owned = nodes.select("conv", "depth", (F.col("cum") - F.col("chars")).alias("cum"), no.alias("leaf"))
    alone = tails(cut).select("conv", F.col("first").alias("depth"), F.col("tail_cum").alias("cum"), F.col("last").cast("int").alias("leaf"))
    past = F.lit(1 << 62)  # whoever owns nothing saves its whole path; the prefixes' own depths are below
    whole_path = cut.filter("last AND size(d1) = n").select("conv", past.alias("depth"), F.col("tail_cum").alias("cum"), no.alias("leaf"))
    ends = leaves.select("conv", past.alias("depth"), F.lit(None).cast("long").alias("cum"), F.lit(1).alias("leaf"))
    rows = owned.unionByName(alone).unionByName(whole_path).unionByName(ends)
    return shared_table(
        rows.groupBy("conv").agg(
            F.min(F.struct("depth", F.col("cum").isNull().alias("_n"), "cum")).alias("f"), F.max("leaf").alias("leaf")
        ).select("conv", F.col("f.depth").alias("owns"), F.col("f.cum").alias("owns_cum"), "leaf"), "trie-conversations",
    )


def _ends_hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ``(depth, d1, d2, range, ids)`` -> ``(depth, d1, d2, ends_sha256)``; one hash is fed at a time."""
    at, sha, out = None, None, []

    def told():
        keys = [pa.array([r[i] for r in out], pa.int64()) for i in range(3)]
        rows = pa.RecordBatch.from_arrays([*keys, pa.array([r[3] for r in out], pa.string())], names=[*KEY, "ends_sha256"])
        out.clear()
        return rows

    for batch in batches:
        for depth, d1, d2, ids in zip(*(batch.column(c).to_pylist() for c in (*KEY, "ids")), strict=True):
            if (depth, d1, d2) != at:
                if at is not None:
                    out.append((*at, sha.hexdigest()))
                at, sha = (depth, d1, d2), hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(ids.encode())
        if out:
            yield told()
    if at is not None:
        out.append((*at, sha.hexdigest()))
        yield told()


def ends(cut: DataFrame) -> DataFrame:
    """``KEY, ends_sha256`` of the nodes that may be shared and at which conversations end."""
    rows = members(cut).filter("ends").select("conv", *KEY)
    ranges = rows.groupBy(*KEY, F.floor(F.col("conv") / ID_RANGE).alias("range")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids")
    )
    return ranges.repartition(*KEY).sortWithinPartitions(*KEY, "range").mapInArrow(
        _ends_hashed, "depth long, d1 long, d2 long, ends_sha256 string"
    )


def with_parent_conv(rows: DataFrame, key: list[Column], nodes: DataFrame, children: DataFrame) -> DataFrame:
    """``rows`` with ``parent_conv``, the smallest member of the node that ``key`` names; null if it is none of ``nodes``.

    Nodes with very many children are few, and looked up by broadcast; the others' rows meet in a
    shuffle, where no node has more than ``HOT_PART`` of them.
    """
    total = children.agg(F.sum("n_children")).first()[0] or 0
    owners = nodes.select(*[F.col(c).alias(f"_{c}") for c in KEY], F.col("conv").alias("parent_conv"))
    many = children.filter(F.col("n_children") > max(1000, int(total * HOT_PART))).select(*[F.col(c).alias(f"_{c}") for c in KEY])
    hot = owners.join(F.broadcast(many), [f"_{c}" for c in KEY], "left_semi")
    named = [F.col(f"_{c}") for c in KEY]
    same = (key[0] == named[0]) & (key[1] == named[1]) & (key[2] == named[2])
    drop = [f"_{c}" for c in KEY]
    tried = rows.join(F.broadcast(hot), same, "left").drop(*drop)
    found, rest = tried.filter("parent_conv IS NOT NULL"), tried.filter("parent_conv IS NULL").drop("parent_conv")
    return found.unionByName(rest.join(owners, same, "left").drop(*drop))


def trie(turns: DataFrame, convs: DataFrame | None = None, conv: str = "conv_id") -> DataFrame:
    """One row per node: ``conv, depth, parent_<conv>, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    ``turns`` is as of ``placed``; ``conv`` and ``depth`` name a node, since a conversation's path has
    one node of every depth and each node is its smallest member's.
    """
    cut = screened(paths(turns, convs))
    nodes = shared_nodes(cut)
    alone = tails(cut)
    above = nodes.filter("depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("p1").alias("d1"), F.col("p2").alias("d2"))
    children = shared_table(
        above.unionByName(alone.select(*KEY)).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_children")), "trie-children"
    )
    leaves = nodes.join(children, KEY, "left_anti").select("conv")
    facts = conversation_facts(cut, nodes, leaves)
    saved = F.when(F.col("owns") > F.col("depth"), F.col("owns_cum") - F.col("cum") + F.col("chars")).otherwise(0)
    sums = members(cut.join(facts, "conv"), "owns", "owns_cum", "leaf").groupBy(*KEY).agg(
        F.sum(saved).alias("saved_tokens"), F.sum("leaf").cast("long").alias("n_leaves")
    )
    nothing = F.sha2(F.lit(""), 256)
    told = (
        nodes.join(children, KEY, "left").join(sums, KEY).join(ends(cut), KEY, "left")
        .withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
        .withColumn("ends_sha256", F.coalesce("ends_sha256", nothing))
    )
    told = with_parent_conv(told, [F.col("depth") - 1, F.col("p1"), F.col("p2")], nodes, children)
    one = F.lit(1).cast("long")
    alone = with_parent_conv(alone, [F.col(c) for c in KEY], nodes, children).withColumn("of", F.col("depth")).drop(*KEY)
    alone = alone.withColumn("depth", F.explode(F.sequence("first", "end"))).select(
        "conv", "depth",
        F.when(F.col("depth") == F.col("first"), F.coalesce("parent_conv", "conv")).otherwise(F.col("conv")).alias("parent_conv"),
        one.alias("n_convs"), F.when(F.col("last") & (F.col("depth") == F.col("end")), 0).otherwise(1).cast("long").alias("n_children"),
        one.alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
        F.when(F.col("last") & (F.col("depth") == F.col("end")), F.sha2(F.col("conv").cast("string"), 256)).otherwise(nothing).alias("ends_sha256"),
    )
    # a prefix that was not proven single but is: its parent may be a single one of an earlier piece
    told = told.withColumn("parent_conv", F.when(F.col("depth") > 0, F.coalesce("parent_conv", "conv")))
    columns = ["conv", "depth", "parent_conv", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return told.select(*columns).unionByName(alone.select(*columns)).withColumnRenamed("conv", conv).withColumnRenamed(
        "parent_conv", f"parent_{conv}"
    )


# --- branches ------------------------------------------------------------------------------------


def branched(turns: DataFrame, every: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin like another one: ``(turns, convs)``, both as ``trie`` takes them.

    Conversation ``c`` begins with the first ``h`` turns of ``c - c % every`` and goes on with its own
    behind its first ``h``; ``h`` is a checksum of its number modulo ``most``.
    """
    known = shared_table(turns, "trie-places")
    convs = known.select("conv").distinct().select(
        "conv", (F.col("conv") - F.col("conv") % every).alias("base"),
        (F.crc32(F.col("conv").cast("string").cast("binary")) % most).alias("h"),
    )
    own_h = F.crc32(F.col("conv").cast("string").cast("binary")) % most
    own = known.filter(F.col("place") >= own_h)
    # at most ``most - 1`` rows a conversation that others begin like
    heads = known.filter((F.col("conv") % every == 0) & (F.col("place") < most - 1)).withColumnRenamed("conv", "base")
    taken = convs.join(heads, "base").filter(F.col("place") < F.col("h"))
    columns = ["conv", "place", "x1", "x2", "chars"]
    return own.select(*columns).unionByName(taken.select(*columns)), convs.select("conv")
