"""Ranked lexical search by a dual tree: the best documents of every item, exactly.

A document's coordinate of a term is its saturated, length-normalised count; an item's is the
term's weight times its occurrences in the item. A score is their dot product, in whole numbers.

1. Items are read in blocks of bounded size. Every block has its own pass: documents become sparse
   counts of the block's terms and a length, stored; statistics are sums over all of them.
2. A task puts the documents it reads into trees. Leaves are batches of documents with the same
   heaviest terms, nodes hold the maximum of every coordinate. The block's items are a tree as well.
3. A pair of nodes is bounded by the dot product of their maxima. If that is less than the weakest
   k-th score of the node's items, no pair of theirs can enter a result, and all are left out at
   once. Otherwise the children are paired, the best bounds first, down to batches of items
   against batches of documents, whose scores are one matrix product.
4. A first pass scores only each item's most promising leaf of every tree. The k-th scores it finds
   are lower bounds for all, so in the second pass most trees end at the root.

Every task returns at most ``k`` documents per item; the best of these are the result. Sums below
2^53 are exact in doubles; where an item may exceed them, scores are computed in 64-bit integers.

Defined cases: null and empty texts have no terms, are not counted and not found; rows that repeat
an id are documents of their own; documents without an id rank after all others of their score;
rows of items that repeat id and text are one item, null ids are an id; an item without a known
term, or an empty table on either side, gives no rows; other columns are ignored; ids of documents
are whole numbers.
"""

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contactloom.llm.shingles import column_bytes
from contactloom.llm.text import alnum_words
from contactloom.sources.shared import shared_table

K = 10
#: Saturation and length normalisation: 75 of 100 parts of a document's length count.
LENGTH_PERCENT, SCALE, SATURATION = 75, 1_000_000_000, 8
TOP_IMPACT = 1_000_000  # no coordinate of a document reaches it
#: Bounds of a block: distinct terms of its items summed, and items.
BLOCK_TERMS, BLOCK_ITEMS = 16_000, 256
ITEM_LEAF, FAN_OUT = 8, 8
LEAF_DOCS, LEAVES = 64, 32
LEAF_CELLS = 1 << 19  # cells of a dense leaf at most; wider vocabularies make smaller leaves
KEPT_CELLS = 1 << 21  # of the dense leaves that are kept, so those under one node of documents

MARGIN = 1 + 1e-9  # for what doubles round off in a bound

#: Bytes of words to lower case, everything else to a blank.
_FOLD = bytes(
    c if c in b"0123456789abcdefghijklmnopqrstuvwxyz" or c > 0x7F else c + 32 if 65 <= c <= 90 else 0x20 for c in range(256)
)


def terms(text: bytes) -> list[bytes]:
    """Terms of a text's UTF-8 bytes; letters beyond ASCII are made of bytes beyond ASCII."""
    return text.translate(_FOLD).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


# --- items ---------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Node:
    """Items ``low`` to ``high`` of a block: the terms they have and, per term, the largest weight."""

    low: int
    high: int
    columns: np.ndarray
    most: np.ndarray
    children: tuple = ()
    weights: np.ndarray | None = None  # of a leaf: terms x items


@dataclass(frozen=True)
class ItemTree:
    """A block's items in the order of the tree; ``names`` are their numbers."""

    root: Node
    names: np.ndarray
    weights: np.ndarray  # of every term, the largest of all items
    width: int
    dtype: type  # in which scores are exact


def item_tree(items: dict[int, dict[int, int]], width: int) -> ItemTree | None:
    """The tree of ``{item: {term: weight}}``; items with the same heaviest terms are near each other."""
    vectors = {i: v for i, v in items.items() if v}
    if not vectors:
        return None
    order = sorted(vectors, key=lambda i: (sorted(vectors[i], key=lambda t: (-vectors[i][t], t))[:3], i))
    wide = any(sum(vectors[i].values()) * TOP_IMPACT >= 1 << 53 for i in order)
    dtype = np.int64 if wide else np.float64
    level = []
    for low in range(0, len(order), ITEM_LEAF):
        batch = order[low : low + ITEM_LEAF]
        columns = np.array(sorted({t for i in batch for t in vectors[i]}), np.int64)
        place = {t: n for n, t in enumerate(columns.tolist())}
        weights = np.zeros((len(columns), len(batch)), dtype)
        for n, i in enumerate(batch):
            weights[[place[t] for t in vectors[i]], n] = list(vectors[i].values())
        level.append(Node(low, low + len(batch), columns, weights.max(axis=1).astype(float), (), weights))
    largest = np.zeros(width)
    for node in level:
        largest[node.columns] = np.maximum(largest[node.columns], node.most)
    while len(level) > 1:
        level = [_parent(level[n : n + FAN_OUT]) for n in range(0, len(level), FAN_OUT)]
    return ItemTree(level[0], np.array(order, np.int64), largest, width, dtype)


def _parent(nodes: list[Node]) -> Node:
    columns = np.unique(np.concatenate([n.columns for n in nodes]))
    most = np.zeros(len(columns))
    for n in nodes:
        at = np.searchsorted(columns, n.columns)
        most[at] = np.maximum(most[at], n.most)
    return Node(nodes[0].low, nodes[-1].high, columns, most, tuple(nodes))


# --- documents -----------------------------------------------------------------------------------


class DocTree:
    """A few thousand documents: leaves of a batch each, and coordinate maxima of leaves and of groups of leaves."""

    def __init__(self, ids, unnamed, sizes, columns, impacts, items: ItemTree, leaf_docs: int):
        rows = np.repeat(np.arange(len(sizes)), sizes)
        worth = items.weights[columns] * impacts
        # heaviest terms first inside a document; a document's batch goes by its two heaviest
        heavy = np.lexsort((columns, -worth, rows))
        starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        first = columns[heavy[starts]]
        second = np.where(sizes > 1, columns[heavy[np.minimum(starts + 1, len(heavy) - 1)]], -1)
        order = np.lexsort((starts, -worth[heavy[starts]], second, first))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        rows = place[rows]
        sort = np.argsort(rows, kind="stable")
        self.rows, self.columns, self.impacts = rows[sort], columns[sort], impacts[sort].astype(items.dtype)
        self.ids, self.unnamed = ids[order], unnamed[order]
        self.leaf_docs, self.width = leaf_docs, items.width
        self.n_leaves = -(-len(order) // leaf_docs)
        self.bounds = np.searchsorted(self.rows, np.arange(self.n_leaves + 1) * leaf_docs)
        leaves = np.zeros((self.n_leaves, items.width))
        np.maximum.at(leaves, (self.rows // leaf_docs, self.columns), self.impacts)
        self.levels = [leaves]
        while len(self.levels[-1]) > 1:
            below = self.levels[-1]
            self.levels.append(np.maximum.reduceat(below, np.arange(0, len(below), FAN_OUT), axis=0))
        self._dense: dict[int, np.ndarray] = {}

    def leaf(self, n: int) -> np.ndarray:
        """The leaf's documents x terms."""
        if n not in self._dense:
            if (len(self._dense) + 1) * self.leaf_docs * self.width > KEPT_CELLS:
                self._dense.clear()
            at = slice(self.bounds[n], self.bounds[n + 1])
            docs = min(self.leaf_docs, len(self.ids) - n * self.leaf_docs)
            dense = np.zeros((docs, self.width), self.impacts.dtype)
            dense[self.rows[at] - n * self.leaf_docs, self.columns[at]] = self.impacts[at]
            self._dense[n] = dense
        return self._dense[n]


class Search:
    """The best ``k`` documents of every item of a block among the trees it has been through."""

    def __init__(self, items: ItemTree, k: int, least: np.ndarray):
        self.items, self.k = items, k
        #: Per item, the score below which nothing can be a result.
        self.least = least.copy()
        none = np.empty(0, np.int64)
        self.best = [(none, none.astype(bool), none)] * len(items.names)  # scores, unnamed, ids
        self.scored = 0

    def _weakest(self, node: Node) -> float:
        return self.least[node.low : node.high].min()

    def through(self, tree: DocTree) -> None:
        self._pairs(tree, self.items.root, len(tree.levels) - 1, np.array([0]))

    def leaders(self, tree: DocTree) -> None:
        """Scores every item leaf with its most promising document leaf only."""
        def leaves(node):
            return [node] if not node.children else [x for c in node.children for x in leaves(c)]

        chosen = [(int(np.argmax(tree.levels[0][:, n.columns] @ n.most)), n) for n in leaves(self.items.root)]
        for leaf, node in sorted(chosen, key=lambda x: x[0]):
            self._score(tree, node, leaf)

    def _pairs(self, tree: DocTree, node: Node, level: int, docs: np.ndarray) -> None:
        """All pairs of a node of items and nodes ``docs`` of a level of the documents' tree."""
        bounds = tree.levels[level][np.ix_(docs, node.columns)] @ node.most * MARGIN
        for n in np.argsort(-bounds, kind="stable"):
            if bounds[n] <= 0 or bounds[n] < self._weakest(node):
                return  # and so are all that follow
            doc = int(docs[n])
            if not level and not node.children:
                self._score(tree, node, doc)
                continue
            below = np.array([doc]) if not level else np.arange(
                doc * FAN_OUT, min((doc + 1) * FAN_OUT, len(tree.levels[level - 1]))
            )
            for child in node.children or (node,):
                self._pairs(tree, child, max(level - 1, 0), below)

    def _score(self, tree: DocTree, node: Node, leaf: int) -> None:
        scores = tree.leaf(leaf)[:, node.columns] @ node.weights
        self.scored += scores.size
        hit = (scores > 0) & (scores >= self.least[node.low : node.high])
        for n in np.flatnonzero(hit.any(axis=0)):
            at = np.flatnonzero(hit[:, n])
            self._keep(node.low + int(n), scores[at, n].astype(np.int64), tree, leaf * tree.leaf_docs + at)

    def _keep(self, item: int, scores: np.ndarray, tree: DocTree, at: np.ndarray) -> None:
        known = self.best[item]
        scores = np.concatenate([known[0], scores])
        unnamed = np.concatenate([known[1], tree.unnamed[at]])
        ids = np.concatenate([known[2], tree.ids[at]])
        first = np.lexsort((ids, unnamed, -scores))[: self.k]
        self.best[item] = scores[first], unnamed[first], ids[first]
        if len(first) == self.k:
            self.least[item] = max(self.least[item], scores[first[-1]])

    def rows(self) -> pa.RecordBatch:
        sizes = [len(b[0]) for b in self.best]
        scores, unnamed, ids = (np.concatenate(x) for x in zip(*self.best, strict=True))
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(self.items.names, sizes)), pa.array(ids, mask=unnamed), pa.array(scores)],
            names=["item", "doc_id", "score"],
        )


FOUND = "item long, doc_id long, score long"


def search_task(
    batches: Iterator[pa.RecordBatch], items: ItemTree, least: np.ndarray, k: int, n_docs: int, n_terms: int, leaders: bool
) -> Iterator[pa.RecordBatch]:
    """Trees of the task's documents ``(doc_id, n, terms, counts)``, each searched and let go."""
    search = Search(items, k, least)
    leaf_docs = max(1, min(LEAF_DOCS, LEAF_CELLS // items.width))
    for batch in batches:
        for low in range(0, batch.num_rows, leaf_docs * LEAVES):
            part = batch.slice(low, leaf_docs * LEAVES)
            ids = part.column(0)
            columns, counts = (part.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in (2, 3))
            sizes = part.column(2).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            norms = np.array(
                [100 - LENGTH_PERCENT + LENGTH_PERCENT * n * n_docs // n_terms for n in part.column(1).to_pylist()], np.int64
            )
            impacts = SCALE * counts // (1000 * counts + SATURATION * np.repeat(norms, sizes))
            unnamed = ids.is_null().to_numpy(zero_copy_only=False)
            tree = DocTree(
                ids.fill_null(0).to_numpy(zero_copy_only=False), unnamed, sizes, columns, impacts, items, leaf_docs
            )
            (search.leaders if leaders else search.through)(tree)
            del tree
    yield search.rows()


# --- jobs ----------------------------------------------------------------------------------------


def count_task(batches: Iterator[pa.RecordBatch], places: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    """``(doc_id, text)`` -> ``(doc_id, n, terms, counts)``: how many terms, and the known ones with their counts."""
    for batch in batches:
        ids, ns, columns, counts, ends = [], [], [], [], [0]
        for doc_id, data in zip(batch.column(0).to_pylist(), column_bytes(batch.column(1)), strict=True):
            words = terms(bytes(data))
            if not words:
                continue
            known = Counter(map(places.get, words))
            known.pop(None, None)
            ids.append(doc_id)
            ns.append(len(words))
            columns.extend(known.keys())
            counts.extend(known.values())
            ends.append(len(columns))
        offsets = pa.array(ends, pa.int32())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()), pa.array(ns, pa.int64()),
                pa.ListArray.from_arrays(offsets, pa.array(columns, pa.int32())),
                pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int64())),
            ],
            names=["doc_id", "n", "terms", "counts"],
        )


COUNTED = "doc_id long, n long, terms array<int>, counts array<long>"


def listed_items(items: DataFrame, id_col: str, text: str) -> DataFrame:
    """``(item, id, text, n)``: distinct items with a number and how many terms they have; stored."""
    rows = items.select(F.col(id_col).alias("id"), F.col(text).alias("text")).filter("text IS NOT NULL").distinct()
    size = F.size(F.array_distinct(alnum_words(F.col("text")))).alias("n")
    return shared_table(rows.select(F.monotonically_increasing_id().alias("item"), "id", "text", size), "search-items")


def search_block(docs: DataFrame, block: list[tuple[int, dict[bytes, int]]], k: int) -> DataFrame | None:
    """``(item, doc_id, score)``, the best ``k`` or fewer of each task, of items ``(item, {term: occurrences})``."""
    spark = docs.sparkSession
    places = {t: n for n, t in enumerate(sorted({t for _, found in block for t in found}))}
    if not places:
        return None
    known = spark.sparkContext.broadcast(places)
    counted = shared_table(docs.mapInArrow(lambda b: count_task(b, known.value), COUNTED), "search-counts")
    n_docs, n_terms = counted.agg(F.count(F.lit(1)), F.sum("n")).first()
    found_in = {r["term"]: r["df"] for r in counted.select(F.explode("terms").alias("term")).groupBy("term").agg(
        F.count(F.lit(1)).alias("df")).collect()}
    if not found_in:
        return None
    weights = {places[t]: weight(n_docs, found_in[places[t]]) for t in places if places[t] in found_in}
    vectors = {
        item: {p: w * times for t, times in found.items() if (w := weights.get(p := places[t], 0))} for item, found in block
    }
    items = item_tree(vectors, len(places))
    if items is None:
        return None
    tree = spark.sparkContext.broadcast(items)
    some = counted.filter(F.size("terms") > 0)
    nothing = np.zeros(len(items.names), np.int64)
    seeds = some.mapInArrow(lambda b: search_task(b, tree.value, nothing, k, n_docs, n_terms, True), FOUND)
    least, place = nothing.copy(), {int(i): n for n, i in enumerate(items.names)}
    nth = Window.partitionBy("item").orderBy(F.desc("score"))
    for r in seeds.withColumn("nth", F.row_number().over(nth)).filter(F.col("nth") <= k).groupBy("item").agg(
        F.count(F.lit(1)).alias("n"), F.min("score").alias("score")
    ).filter(F.col("n") == k).collect():
        least[place[r["item"]]] = r["score"]
    return some.mapInArrow(lambda b: search_task(b, tree.value, least, k, n_docs, n_terms, False), FOUND)


def search(
    docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text: str = "text",
    item_col: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """``(item_col, rank, id_col, score)``: of every item the ``k`` best documents, best first."""
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).filter("text IS NOT NULL")
    every = listed_items(items, item_col, item_text)
    facts = every.agg(F.count(F.lit(1)), F.sum("n")).first()
    blocks = max(1, -(-facts[0] // BLOCK_ITEMS), -(-(facts[1] or 0) // BLOCK_TERMS))
    tables = []
    for n in range(blocks):
        rows = every.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == n).select("item", "text").collect()
        block = [(r["item"], Counter(terms(r["text"].encode()))) for r in rows]
        if (found := search_block(given, block, k)) is not None:
            tables.append(shared_table(found, "search-found"))
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    if not tables:
        tables = [docs.sparkSession.createDataFrame([], FOUND)]
    found = tables[0]
    for more in tables[1:]:
        found = found.unionByName(more)
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.join(every.select("item", F.col("id").alias("_item")), "item").select(
        F.col("_item").alias(item_col), "rank", F.col("doc_id").alias(id_col), "score"
    )
