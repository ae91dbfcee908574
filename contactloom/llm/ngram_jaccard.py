"""N-gram Jaccard join with adaptive multi-match prefixes, and the groups its links make.

Two texts link when the Jaccard similarity of their sets of 5-word shingles is 0.8 or more. In
any global order of shingles, two linked sets that both take their first ``n - ceil(0.8 n) + m``
shingles share at least ``m`` of these (``m`` the smaller of the two documents' own). A longer
prefix thus asks for more matches before a pair is verified. Steps:

1. Sets are hashed in Arrow batches and every row gets a number of its own; equal sets become one,
   represented by its smallest row number. Up to the end only these numbers are compared and joined.
2. Every set sends a prefix in hash order with ``m = 1 + n // 20``. Sets with fewer shared prefix
   shingles than that are linked with nothing, which is most of them, and end here.
3. The others' shingles are counted exactly and ordered rarest first. Sets that hold fewer of them in
   common with all others together than they need to share with one are gone. Each document takes the
   ``m`` of 1, 2, 4 or 8 whose prefix has the least estimated cost: postings to read plus candidates
   to verify, both from the counts.
4. In each posting list every document meets the list's leader: first the document whose shingles are
   the most common, which of a family of copies is the least changed, then in further rounds documents
   chosen by hash, the same in all lists. Those that share enough prefix shingles are verified, and links
   are joined into components. Only pairs of different components that share enough prefix shingles are
   left, and all of them are verified; pairs inside one component can add nothing.
5. A shared shingle counts for a pair only where both can still have enough in common behind it, by their
   sizes and the shingle's places in their orders. So a changed copy, whose changes come first in its
   order, does not meet all other copies through what is common to them.

A large group of near copies so costs a few links per document, not all its pairs, and no list is
gathered in a task. Texts are never shuffled: the second reading, for whole sets, picks its rows with a
Bloom filter of bounded size, and rows too many change nothing. Hashes have 64 bits; a set is named by
128 bits.

Defined cases: null, empty and blank texts have no shingles and link with nothing; rows without a
doc_id link like all others but name no component and have a null component_id; of rows that repeat
a doc_id every set links, and their one row has the size of the largest and the smallest of their
component_ids; an empty table gives an empty table; other columns are ignored.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactloom.llm.components import components
from contactloom.llm.shingles import column_bytes, set_digest, shingle_set
from contactloom.llm.text import boxed, row_key
from contactloom.sources.shared import shared_table

SHINGLE = 5
PERCENT = 80
MATCHES = (1, 2, 4, 8)
#: Rounds of leaders; they decide how many pairs are left to verify one by one, not what is found.
LEADER_ROUNDS = 2
#: Cost of verifying a candidate, in postings read.
VERIFY_COST = 4

SET_FIELDS = "doc_id long, key long, n int, d1 long, d2 long, tokens array<long>"
BATCH_ROWS = 256
#: Bits of the Bloom filter a row, two of which are set, and at most.
BLOOM_BITS, BLOOM_MOST = 32, 1 << 27


def least_overlap(n):
    """Shingles that a set of n shares with any linked set at least: ceil(0.8 n)."""
    return (n * PERCENT + 99) // 100


def first_matches(n):
    """Matches that the first prefix of a set of n asks for."""
    return 1 + n // 20


def first_prefix(n: int) -> int:
    return n - least_overlap(n) + first_matches(n)


def _sets(batches: Iterator[pa.RecordBatch], prefix_only: bool) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("n", pa.int32()), ("d1", pa.int64()), ("d2", pa.int64()),
                        ("tokens", pa.list_(pa.int64()))])

    def batch(rows, tokens):
        ids, keys, ns, d1, d2 = zip(*rows, strict=True)
        lengths = np.array([len(t) for t in tokens], np.int32)
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        listed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(tokens)))
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(ns, pa.int32()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), listed],
            schema=schema,
        )

    for given in batches:
        rows, tokens, held = [], [], 0
        named = given.column(0).to_pylist(), given.column(1).to_pylist()
        for doc_id, key, data in zip(*named, column_bytes(given.column(2)), strict=True):
            found = shingle_set(data, SHINGLE)
            rows.append((doc_id, key, len(found), *set_digest(found)))
            if prefix_only and len(found):
                # the smallest hashes; sets are sorted
                found = found[: first_prefix(len(found))]
            tokens.append(found.view(np.int64))
            held += len(found)
            if len(rows) >= BATCH_ROWS * 8 or held > 1 << 18:
                yield batch(rows, tokens)
                rows, tokens, held = [], [], 0
        if rows:
            yield batch(rows, tokens)


def shingle_sets(docs: DataFrame, text: str, id_col: str, prefix_only: bool) -> DataFrame:
    """``(doc_id, key, n, d1, d2, tokens)``: the set's size and name, and its hashes or their prefix.

    ``key`` is the row's hash of id and text, as ``row_key`` has it.
    """
    _, key = row_key(id_col, text)
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), key.alias("key"), F.col(text).alias("text"))
    return given.mapInArrow(lambda b: _sets(b, prefix_only), SET_FIELDS)


def _need(n: Column) -> Column:
    return F.floor((n * PERCENT + 99) / 100).cast("int")


def members_of_sets(sets: DataFrame) -> DataFrame:
    """``(node, doc_id, key, n, d1, d2, rep)`` of every row; ``rep`` is the smallest node with the same set."""
    reps = sets.filter("n > 0").groupBy("n", "d1", "d2").agg(F.min("node").alias("rep"))
    return sets.select("node", "doc_id", "key", "n", "d1", "d2").join(reps, ["n", "d1", "d2"], "left").select(
        "node", "doc_id", "key", "n", "d1", "d2", F.coalesce("rep", "node").alias("rep")
    )


def alive(sets: DataFrame, members: DataFrame) -> DataFrame:
    """``(node, key, n, d1, d2)`` of representatives whose first prefix has enough shared shingles."""
    # a table of its own, so that Spark knows its size and can spare the prefixes a shuffle
    copies = shared_table(members.filter("node != rep OR n = 0").select("node"), "set-copies")
    prefixes = sets.filter("n > 0").join(copies, "node", "left_anti").select("node", F.explode("tokens").alias("token"))
    common = prefixes.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df >= 2").select("token")
    matched = prefixes.join(common, "token").groupBy("node").agg(F.count(F.lit(1)).alias("m"))
    asked = 1 + F.floor(_need(F.col("n")) / 20)
    return (
        matched.join(members.filter("node = rep"), "node")
        .filter(F.col("m") >= asked)
        .select("node", "key", "n", "d1", "d2")
    )


def bloom(keys: DataFrame) -> np.ndarray:
    """A bit map of 64-bit ``key``s, as words; at most BLOOM_MOST bits come to the driver."""
    width = min(BLOOM_MOST, max(1 << 12, 1 << (BLOOM_BITS * keys.count()).bit_length()))
    places = F.array(F.col("key"), F.shiftrightunsigned("key", 32))
    found = keys.select(F.explode(places).alias("at")).select(F.col("at").bitwiseAND(width - 1).alias("at"))
    words = found.groupBy(F.shiftright("at", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(at & 63 AS int))")).alias("bits")
    ).toArrow()
    bits = np.zeros(width // 64, np.uint64)
    bits[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return bits


def maybe_in(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key may be in the filter; it never misses one."""
    own = keys.view(np.uint64)
    hit = np.ones(len(own), bool)
    for at in (own, own >> np.uint64(32)):
        at = at & np.uint64(len(bits) * 64 - 1)
        hit &= (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
    return hit


FULL_FIELDS = "n int, d1 long, d2 long, tokens array<long>"


def _full_sets(batches: Iterator[pa.RecordBatch], bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """``(key, text)`` -> whole sets of the rows that may be wanted."""

    def batch(rows, sets):
        ns, d1, d2 = zip(*rows, strict=True)
        ends = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
        listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))
        return pa.RecordBatch.from_arrays(
            [pa.array(ns, pa.int32()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), listed],
            names=["n", "d1", "d2", "tokens"],
        )

    for given in batches:
        wanted = given.filter(pa.array(maybe_in(bits, given.column(0).to_numpy(zero_copy_only=False))))
        rows, sets, held = [], [], 0
        for data in column_bytes(wanted.column(1)):
            found = shingle_set(data, SHINGLE)
            if not len(found):
                continue
            rows.append((len(found), *set_digest(found)))
            sets.append(found)
            held += len(found)
            if held > 1 << 18:
                yield batch(rows, sets)
                rows, sets, held = [], [], 0
        if rows:
            yield batch(rows, sets)


def full_sets(docs: DataFrame, left_over: DataFrame, text: str, id_col: str) -> DataFrame:
    """``(node, n, d1, d2, tokens)``: the sets of ``left_over`` and maybe others, each once.

    ``node`` is a number of this table's own; the reading is not shuffled.
    """
    _, key = row_key(id_col, text)
    bits = docs.sparkSession.sparkContext.broadcast(bloom(left_over.select("key")))
    found = docs.select(key.alias("key"), F.col(text).alias("text")).mapInArrow(
        lambda b: _full_sets(b, bits.value), FULL_FIELDS
    )
    found = shared_table(found.withColumn("node", F.monotonically_increasing_id()), "sets")
    # sets that stand there several times, by rows of one id and text
    name = ["n", "d1", "d2"]
    first = found.groupBy(*name).agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("times")).filter("times > 1")
    spare = shared_table(found.select("node", *name).join(first, name).filter("node != first").select("node"), "spare-sets")
    return found.join(spare, "node", "left_anti")


def ordered_sets(full: DataFrame) -> DataFrame:
    """``(node, n, toks)``: shingles that other sets have too, rarest first, as ``(df, token)``.

    Sets that share too few of their shingles with all others together are gone.
    """
    tokens = full.select("node", "n", F.explode("tokens").alias("token"))
    common = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df >= 2")
    return (
        tokens.join(common, "token")
        .groupBy("node", "n")
        .agg(F.array_sort(F.collect_set(F.struct("df", "token"))).alias("toks"))
        .filter(F.size("toks") >= _need(F.col("n")))
    )


def _least_common(n1: Column, n2: Column) -> Column:
    """Shingles that linked sets of these sizes have in common at least."""
    return F.ceil((n1 + n2) * PERCENT / (100 + PERCENT))


def chosen_matches(n: Column, toks: Column) -> Column:
    """The number of matches with the least estimated cost.

    It is estimated over the prefix that counts for partners of the same size. Shingles that no other
    set has come before the shared ones.
    """
    shared = F.size(toks)

    def cost(m: int) -> Column:
        counts = F.greatest(F.lit(1), F.least(shared, shared - _least_common(n, n) + m)).cast("int")
        taken = F.slice(toks, F.lit(1), counts)
        read = F.aggregate(taken, F.lit(0).cast("long"), lambda a, t: a + t["df"])
        candidates = (read - counts) / m
        return F.when(F.lit(m) <= _need(n), F.struct((read + candidates * VERIFY_COST).alias("cost"), F.lit(m).alias("m")))

    return F.array_min(F.array_compact(F.array(*[cost(m) for m in MATCHES])))["m"]


def postings(ordered: DataFrame) -> DataFrame:
    """``(token, node, n, m, left, common)`` of every prefix shingle.

    ``left`` is how many of the set's shared shingles are not before it, itself included; ``common`` is
    how common the set's shingles are.
    """
    shared = F.size("toks")
    end = F.least(shared, shared - _need(F.col("n")) + F.col("m"))
    chosen = ordered.withColumn("m", chosen_matches(F.col("n"), F.col("toks"))).withColumn(
        "common", F.aggregate("toks", F.lit(0).cast("long"), lambda a, t: a + t["df"]) / F.col("n")
    )
    return chosen.select(
        "node", "n", "m", "common", F.inline(F.transform(F.slice("toks", F.lit(1), end), lambda t, i: F.struct(
            t["token"].alias("token"), (shared - i).alias("left")
        )))
    )


def _counts(n1: str, left1: str, m1: str, n2: str, left2: str, m2: str) -> Column:
    """Whether a shared shingle can be one of the first ``m`` that linked sets have in common.

    Of these the k-th has k - 1 others before it and at most the lesser ``left`` from it on.
    """
    n1, left1, m1, n2, left2, m2 = map(F.col, (n1, left1, m1, n2, left2, m2))
    return F.least(left1, left2) + F.least(m1, m2) - 1 >= _least_common(n1, n2)


def verified(pairs: DataFrame, ordered: DataFrame) -> DataFrame:
    """The ``(a, b)`` that link."""
    sets = ordered.select("node", "n", F.transform("toks", lambda t: t["token"]).alias("tokens"))
    left = sets.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("tokens").alias("t_a"))
    right = sets.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("tokens").alias("t_b"))
    both = F.size(F.array_intersect("t_a", "t_b"))
    return (
        pairs.join(left, "a").join(right, "b")
        .withColumn("both", both)
        .filter(F.col("both") * 100 >= (F.col("n_a") + F.col("n_b") - F.col("both")) * PERCENT)
        .select("a", "b")
    )


def _enough(met: DataFrame) -> DataFrame:
    """The ``(a, b)`` that met in as many lists as the smaller of their two ``m`` asks for."""
    return met.groupBy("a", "b").agg(
        F.count(F.lit(1)).alias("shared"), F.min(F.least("m1", "m2")).alias("asked")
    ).filter("shared >= asked").select("a", "b")


def open_lists(labelled: DataFrame) -> DataFrame:
    """The lists with documents of several components."""
    mixed = labelled.groupBy("token").agg(
        F.min("component").alias("low"), F.max("component").alias("high")
    ).filter("low < high").select("token")
    return labelled.join(mixed, "token")


def leader_pairs(labelled: DataFrame, turn: int = 0) -> DataFrame:
    """``(a, b)``: every document with the leaders of its posting lists, if they share enough.

    ``labelled`` is ``(token, node, n, m, left, common, component)``; pairs inside a component are not made.
    """
    order = (-F.col("common")) if not turn else F.xxhash64("node", F.lit(turn))
    leaders = labelled.groupBy("token").agg(F.min(F.struct(order.alias("order"), "node", "n", "left", "m", "component")).alias("l"))
    met = (
        labelled.join(leaders, "token")
        .filter((F.col("l.component") != F.col("component")) & _counts("n", "left", "m", "l.n", "l.left", "l.m"))
        .select(
            F.least("node", "l.node").alias("a"), F.greatest("node", "l.node").alias("b"),
            F.col("l.m").alias("m1"), F.col("m").alias("m2"),
        )
    )
    return _enough(met)


def pairs_between(labelled: DataFrame) -> DataFrame:
    """``(a, b)`` of different components that share enough prefix shingles.

    ``labelled`` is ``(token, node, n, m, left, component)``. Lists of one component end first; in the
    others components are paired, then their documents, so no pair inside a component is made.
    """
    mixed = open_lists(labelled)
    # of a component's documents in a list, the one that allows most in every respect
    sides = mixed.groupBy("token", "component").agg(F.min("n").alias("n"), F.max("left").alias("left"), F.max("m").alias("m"))
    one, two = (sides.select("token", *[F.col(c).alias(f"{c}{i}") for c in ("component", "n", "left", "m")]) for i in (1, 2))
    met = one.join(two, "token").filter(
        (F.col("component1") < F.col("component2")) & _counts("n1", "left1", "m1", "n2", "left2", "m2")
    ).select("token", F.col("component1").alias("c1"), F.col("component2").alias("c2"))
    first = mixed.select("token", F.col("component").alias("c1"), F.col("node").alias("a"), F.col("n").alias("n1"), F.col("left").alias("left1"), F.col("m").alias("m1"))
    second = mixed.select("token", F.col("component").alias("c2"), F.col("node").alias("b"), F.col("n").alias("n2"), F.col("left").alias("left2"), F.col("m").alias("m2"))
    both = met.join(first, ["token", "c1"]).join(second, ["token", "c2"])
    return _enough(both.filter(_counts("n1", "left1", "m1", "n2", "left2", "m2")))


def _labelled(df: DataFrame, labels: DataFrame, by: str) -> DataFrame:
    return df.join(labels.withColumnRenamed("node", by), by, "left").withColumn(
        "component", F.coalesce("component", by)
    )


def grouped_rows(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``(doc_id, key, n, component)`` of every row; rows of one component reach each other by links."""
    sets = shared_table(
        shingle_sets(docs, text, id_col, prefix_only=True).withColumn("node", F.monotonically_increasing_id()), "set-prefixes"
    )
    members = shared_table(members_of_sets(sets), "set-members")
    left_over = shared_table(alive(sets, members), "set-alive")
    full = full_sets(docs, left_over, text, id_col)
    ordered = shared_table(ordered_sets(full), "sets-ordered")
    posted = shared_table(postings(ordered), "postings")
    labels = posted.sparkSession.createDataFrame([], "node long, component long")
    for turn in range(LEADER_ROUNDS + 1):
        if not turn:
            labelled = posted.withColumn("component", F.col("node"))
        else:
            labelled = shared_table(_labelled(posted, labels, "node"), "labelled-postings")
        pairs = leader_pairs(open_lists(labelled), turn) if turn < LEADER_ROUNDS else pairs_between(labelled)
        links = shared_table(verified(pairs, ordered), "links-found")
        if not links.isEmpty():
            edges = links.unionByName(labels.select(F.col("node").alias("a"), F.col("component").alias("b")))
            labels = shared_table(components(edges, "a", "b"), "groups")
    # from numbers of full sets back to representatives, by the sets' names
    name = ["n", "d1", "d2"]
    rep = full.select("node", *name).join(left_over.withColumnRenamed("node", "rep"), name).select("node", "rep")
    named = labels.join(rep, "node").select("rep", F.col("component").alias("node")).join(
        rep.withColumnRenamed("rep", "of"), "node"
    ).select(F.col("rep").alias("node"), F.col("of").alias("component"))
    grouped = _labelled(members.select("doc_id", "key", "n", "rep"), shared_table(named, "named-groups"), "rep")
    return shared_table(grouped.select("doc_id", "key", "n", "component"), "grouped-rows")


def linked_groups(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: ``id_col``, ``n_shingles``, ``component_id``.

    ``component_id`` is the smallest doc_id that can be reached by links, its own included.
    """
    rows = grouped_rows(docs, text, id_col)
    names = rows.groupBy("component").agg(F.min("doc_id").alias("name"))
    named = rows.filter(F.col("doc_id").isNotNull()).join(names, "component")
    by_id = named.groupBy("doc_id").agg(F.max("n").alias("n"), F.min("name").alias("name"))
    unnamed = rows.filter(F.col("doc_id").isNull()).select("doc_id", "n", F.lit(None).cast("long").alias("name"))
    return by_id.unionByName(unnamed).select(
        F.col("doc_id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.col("name").alias("component_id"),
    )


def keep_one(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with one document of each group, the one with the smallest id; a document is all rows of an id.

    Rows without an id stay. The ids that go are a table of known size, which Spark broadcasts if it
    is small. Where ids may repeat or be null, ``keep_one_row`` judges every row by its own text.
    """
    gone = linked_groups(docs.select(id_col, text), text, id_col).filter(F.col(id_col) != F.col("component_id"))
    gone = shared_table(gone.select(F.col(id_col).cast("long").alias("gone")), "near-copies")
    rows = boxed(docs, id=F.col(f"`{id_col}`").cast("long"))
    return rows.join(gone, F.col("id") == F.col("gone"), "left_anti").select("_r.*")


def keep_one_row(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each group: the smallest id's, a row without an id only if no other is there.

    Rows are named by id and text. Of rows that repeat both, the one with the smallest hash of all
    columns stays. Rows without shingles stay. Ids of which nothing stays go by the id alone, which
    is a smaller table; the others go by both.
    """
    rows = grouped_rows(docs, text, id_col)
    first = rows.filter("n > 0").groupBy("component").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key")).alias("f")
    ).select("component", F.col("f.doc_id").alias("f_id"), F.col("f.key").alias("f_key"))
    stays = (F.col("n") == 0) | (F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("key") == F.col("f_key")))
    judged = shared_table(
        rows.join(first, "component", "left").select("doc_id", "key", "n", stays.alias("stays")), "judged-rows"
    )
    ids = shared_table(
        judged.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("gone"))
        .agg(F.max("stays").alias("some")).filter("NOT some").select("gone"), "near-copies",
    )
    keys = shared_table(
        judged.filter("NOT stays").join(ids, F.col("doc_id") == F.col("gone"), "left_anti")
        .select(F.col("doc_id").alias("of_id"), F.col("key").alias("of_row")).distinct(), "near-copies-by-text",
    )
    again = shared_table(
        judged.filter("stays AND n > 0").groupBy(F.col("doc_id").alias("of_id"), F.col("key").alias("of_row"))
        .agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("of_id", "of_row"), "repeated-rows",
    )
    _, key = row_key(id_col, text)
    listed = boxed(docs, id=F.col(f"`{id_col}`").cast("long"), row=key)

    def named(table: DataFrame):
        return F.col("id").eqNullSafe(table["of_id"]) & (F.col("row") == table["of_row"])

    kept = listed.join(ids, F.col("id") == F.col("gone"), "left_anti").join(keys, named(keys), "left_anti")
    if again.isEmpty():
        return kept.select("_r.*")
    one = kept.join(again, named(again), "left_semi").groupBy("id", "row").agg(
        F.min_by("_r", F.xxhash64("_r")).alias("_r")
    )
    return kept.join(again, named(again), "left_anti").select("_r.*").unionByName(one.select("_r.*"))
