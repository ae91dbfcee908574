"""Ranked search, prefix trie and mixing against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from contactloom.llm import mixing, prefix_trie, ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
A_TO_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- ranked search -----------------------------------------------------------------------------


def terms_of(text):
    return [t.translate(A_TO_Z) for t in TERM.findall(text or "")]


def ranked(docs, items, k=10):
    """``(item, rank, doc_id, score)`` of lists of ``(id, text)``."""
    counted = [(i, Counter(t), len(t)) for i, text in docs if (t := terms_of(text))]
    n_docs, n_terms = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    rows = set()
    for item, text in set(items):
        wanted = Counter(t for t in terms_of(text) if t in df)
        scores = []
        for doc_id, tf, n in counted:
            m = 100 - 75 + 75 * n * n_docs // n_terms
            score = sum(
                times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 8 * m))
                for t, times in wanted.items() if t in tf
            )
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0, doc_id))
        for rank, (score, _, _, doc_id) in enumerate(sorted(scores, key=lambda x: x[:3])[:k], 1):
            rows.add((item, rank, doc_id, -score))
    return rows


@pytest.fixture(scope="module")
def items(odd_texts):
    rng = random.Random(3)
    some = rng.sample([t for t in odd_texts.values() if t], 40)
    listed = [(i, " ".join(t.split()[:30])) for i, t in enumerate(some)]
    return [*listed, (None, "w1 w2 w3"), (90, None), (91, ""), (92, "neverseenanywhere"), (0, listed[0][1]), (93, "W5 w5 w5 é É")]


def searched(spark, docs, items):
    table = spark.createDataFrame([(*i, 7, 1) for i in items], "item_id long, text string, doc_id int, rank int")
    return [tuple(r) for r in ranked_search.search(docs, table).select("item_id", "rank", "doc_id", "score").collect()]


def test_search_equals_brute_force(spark, odd_docs, odd_texts, items):
    rows = searched(spark, odd_docs, items)
    assert len(rows) == len(set(rows))
    assert set(rows) == ranked(list(odd_texts.items()), items)


def test_search_in_blocks_of_items(spark, odd_docs, odd_texts, items, monkeypatch):
    monkeypatch.setattr(ranked_search, "BLOCK_ITEMS", 12)
    assert set(searched(spark, odd_docs, items)) == ranked(list(odd_texts.items()), items)


def test_search_ties_null_ids_and_repeated_rows(spark):
    docs = [(3, "a b"), (None, "a b"), (1, "a b"), (1, "a b"), (2, None), (5, "c"), (None, "c c")] + [(10 + i, "a b") for i in range(20)]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = searched(spark, table, [(7, "a A"), (8, "c")])
    assert sorted(r for r in got if r[0] == 7) == sorted(r for r in ranked(docs, [(7, "a a")]))
    assert [r[2] for r in sorted(got) if r[0] == 7][:3] == [1, 1, 3]
    assert [r[2] for r in sorted(got) if r[0] == 8] == [None, 5]


def test_search_of_nothing(spark, odd_docs, no_docs):
    one = [(1, "w1")]
    assert searched(spark, no_docs, one) == []
    assert searched(spark, odd_docs, []) == []
    assert searched(spark, odd_docs, [(1, "neverseenanywhere"), (2, None)]) == []


@pytest.mark.parametrize("wide", [False, True])
def test_trees_lose_nothing_and_leave_pairs_out(wide):
    rng = np.random.default_rng(1)
    width, n_docs = 200, 3_000
    # documents of many topics: ten terms each out of their topic's twenty
    topics = rng.integers(0, 10, n_docs)
    rows = [np.sort(rng.choice(20, 10, replace=False)) + 20 * t for t in topics]
    impacts = [rng.integers(1, 1_000_000, 10) for _ in rows]
    scale = 1 << 24 if wide else 1
    items = {i: {int(t): int(rng.integers(1, 9000)) * scale for t in 20 * (i % 10) + rng.choice(20, 4, replace=False)} for i in range(50)}
    tree = ranked_search.item_tree(items, width)
    assert tree.dtype is (np.int64 if wide else np.float64)
    search = ranked_search.Search(tree, 10, np.zeros(len(items), np.int64))
    for low in range(0, n_docs, 1_000):
        part = slice(low, low + 1_000)
        search.through(ranked_search.DocTree(
            np.arange(low, low + 1_000), np.zeros(1_000, bool), np.full(1_000, 10), np.concatenate(rows[part]),
            np.concatenate(impacts[part]), tree, 16,
        ))
    for n, name in enumerate(tree.names):
        scores = sorted(
            ((-sum(items[int(name)].get(int(t), 0) * int(v) for t, v in zip(rows[d], impacts[d])), d) for d in range(n_docs))
        )[:10]
        assert list(zip(-search.best[n][0], search.best[n][2])) == scores
    assert search.scored < n_docs * len(items) / 4


# --- prefix trie -------------------------------------------------------------------------------


def trie_of(whole):
    """Nodes of ``{conversation: [(role, text), ...]}`` as the operator's rows."""
    members = defaultdict(list)
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            members[tuple(whole[c][:d])].append(c)
    saved, leaves, children = Counter(), Counter(), Counter()
    for k in members:
        if k:
            children[k[:-1]] += 1
    for k, convs in members.items():
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(convs) - 1) * len(k[-1][1]) if k else 0
            leaves[k[:d]] += not children[k]
    rows = set()
    for k, convs in members.items():
        ends = ",".join(str(c) for c in convs if len(whole[c]) == len(k))
        rows.add((
            convs[0], len(k), members[k[:-1]][0] if k else None, len(convs), children[k], leaves[k], saved[k],
            hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return rows


def ordered(rows):
    """``{conversation: [(role, text), ...]}`` of rows; nulls are empty, null turns first."""
    whole = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            whole[conv].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(v)] for c, v in whole.items()}


def rebuilt(whole):
    """Every conversation with the beginning of the one it branches from."""
    found = {}
    for c, turns in whole.items():
        h = zlib.crc32(str(c).encode()) % 6
        found[c] = whole.get(c - c % 100, [])[:h] + turns[h:]
    return found


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def nodes(turns, convs=None):
    rows = [tuple(r) for r in prefix_trie.trie(turns, convs).select(*NODE).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(11)
    rows = []
    for c in [*range(0, 60), *range(100, 140), *range(255, 280), 990]:
        lead = rng.choice([[], ["hello"], ["hello", "how"], ["hello", "how", "are you"]])
        said = lead + [rng.choice(["x", "yes", "no", "é日", ""]) for _ in range(rng.randint(0 if lead else 1, 6))]
        rows += [(c, t, "user" if t % 2 == 0 else "assistant", s) for t, s in enumerate(said)]
    long = [rng.choice(["a", "bb", "ccc"]) for _ in range(3 * prefix_trie.PIECE + 7)]
    for c, n in ((300, len(long)), (301, len(long)), (302, prefix_trie.PIECE), (303, 2 * prefix_trie.PIECE + 1), (304, len(long) - 1)):
        rows += [(c, t, "user", s) for t, s in enumerate(long[:n])]
    rows += [(305, t, "user", s) for t, s in enumerate(long[: 300] + ["other"] + long[300:])]
    rows += [(400, None, None, None), (400, 0, "user", None), (401, None, "", ""), (401, 0, "user", "")]
    rows += [(402, 5, "user", "same"), (402, 5, "user", "same"), (None, 0, "user", "hello"), (403, -1, "a\nb", "c"), (404, -1, "a", "b\nc")]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def talk_table(spark, talks):
    return spark.createDataFrame(
        [(*r, 1, "x") for r in talks], "conv_id long, turn long, role string, text string, depth int, conv string"
    ).repartition(6)


def test_branched_trie_equals_brute_force(talk_table, talks):
    assert nodes(*prefix_trie.branched(prefix_trie.placed(talk_table))) == trie_of(rebuilt(ordered(talks)))


def test_trie_does_not_depend_on_the_sketch(talk_table, talks, monkeypatch):
    monkeypatch.setattr(prefix_trie, "sketch", lambda found, width: np.full((2, width // 8), 255, np.uint8))
    assert nodes(prefix_trie.placed(talk_table)) == trie_of(ordered(talks))


def test_estimate_of_one_is_proof(spark):
    rows = [([i, i % 50], [7 * i, i % 50]) for i in range(1000, 3000)]
    found = spark.createDataFrame(rows, "d1 array<long>, d2 array<long>").repartition(5)
    width = prefix_trie.sketch_width(4000)
    bits = prefix_trie.sketch(found, width)
    d1 = np.array([x for r in rows for x in r[0]])
    d2 = np.array([x for r in rows for x in r[1]])
    shared = prefix_trie.maybe_shared(bits, d1, d2)
    assert shared[1::2].all()
    assert 0 < (~shared[::2]).sum() and shared[::2].mean() < 0.1


def test_places_of_a_conversation_over_many_parts(spark):
    rows = [(5, t, "user", str(t % 7)) for t in range(2_000)] + [(6, t, "user", str(t % 7)) for t in range(1_000)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(8)
    placed = prefix_trie.placed(table)
    assert [(r.conv, r.place) for r in placed.orderBy("conv", "place").collect()] == [(r[0], r[1]) for r in rows]
    chars = {(r[0], r[1]): len(r[3]) for r in rows}
    assert {(r.conv, r.place): r.chars for r in placed.collect()} == chars


def test_trie_of_nothing(spark, talk_table):
    assert nodes(*prefix_trie.branched(prefix_trie.placed(talk_table.limit(0)))) == set()


# --- mixing ------------------------------------------------------------------------------------


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def shares(sizes):
    """``{source: target}`` by handing out what is above, round by round."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weights = {s: 1 + n % 3 for n, s in enumerate(order)}
    target, open_, left = dict.fromkeys(sizes, 0.0), set(sizes), float(sum(sizes.values()))
    while open_ and left > 1e-9:
        whole = sum(weights[s] for s in open_)
        for s in open_:
            target[s] += left * weights[s] / whole
        left = sum(max(0.0, target[s] - 3 * sizes[s]) for s in open_)
        for s in list(open_):
            if target[s] >= 3 * sizes[s]:
                target[s] = 3.0 * sizes[s]
                open_.discard(s)
    return target


def mixed(docs, targets):
    """Sorted ``(doc_id, size, source_size, taken)`` for whole words of the given targets."""
    by_source = defaultdict(list)
    for doc_id, text, source in docs:
        told = ":".join(x for x in ("0", None if doc_id is None else str(doc_id), text) if x is not None)
        by_source[source].append((hashlib.md5(told.encode()).hexdigest(), words(text), doc_id))
    rows = []
    for source, listed in by_source.items():
        total, budget, at = sum(x[1] for x in listed), math.floor(targets[source]), 0
        for _, size, doc_id in sorted(listed, key=lambda x: (x[0], x[1])):
            taken = sum(max(0, min(size, budget - (e * total + at))) for e in range(3))
            rows.append((doc_id, size, total, taken))
            at += size
    return sorted(rows, key=str)


@pytest.fixture(scope="module")
def sourced(odd_texts):
    docs = [(i, t, "s0" if i % 3 else f"s{i % 11}" if i % 5 else None) for i, t in odd_texts.items()]
    return docs + [(None, "no id here", "s0"), (None, "no id here", "s0"), (7, "a b c", "tiny"), (7, "a b c", "tiny"), (8, " ", "blank")]


def mix_of(spark, docs):
    table = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, source string, size int, row int").repartition(5)
    placed = mixing.streams(table)
    copies = mixing.mix(placed)
    return placed, copies


def test_mix_equals_brute_force(spark, sourced):
    placed, copies = mix_of(spark, sourced)
    sizes = Counter()
    for _, text, source in sourced:
        sizes[source] += words(text)
    targets = {r.source: r.target for r in placed.select("source", "target").distinct().collect()}
    want = shares(sizes)
    assert set(targets) == set(want)
    assert all(targets[s] == pytest.approx(want[s]) for s in want)
    assert sum(targets.values()) == pytest.approx(sum(sizes.values()))
    rows = mixing.taken_words(placed, copies).select("doc_id", "size", "source_size", "taken").collect()
    assert sorted((tuple(r) for r in rows), key=str) == mixed(sourced, targets)
    by_source = Counter()
    for r in copies.collect():
        by_source[r.source] += r.words
    assert all(by_source[s] == math.floor(targets[s]) for s in targets)


def test_mix_is_in_training_order_and_repeatable(spark, sourced):
    first, second = ([tuple(r) for r in mix_of(spark, docs)[1].drop("row").collect()] for docs in (sourced, sourced[::-1]))
    key = lambda r: (r[0], str(r))
    assert sorted(first, key=key) == sorted(second, key=key)
    assert [r[0] for r in first] == sorted(r[0] for r in first)
    # light sources fade and heavy ones rise
    by_source = defaultdict(list)
    for r in first:
        by_source[r[3]].append((r[1], r[5]))
    assert all(0 <= t < 1 for told in by_source.values() for t, _ in told)


def test_demand_is_the_inverse_of_the_schedule(spark):
    knots = ((0.0, 0.0), (0.25, 2.0), (0.25 + 0.25, 2.0), (0.75, 0.0), (0.875, 0.0), (1.0, 1.0))
    rows = spark.range(1001).selectExpr("id / 1000 AS t")
    got = rows.select("t", mixing.given(rows.t, knots).alias("s")).select("t", "s", mixing.due(mixing.F.col("s"), knots).alias("u"))
    got = got.select("*", mixing.given(mixing.F.col("u"), knots).alias("again")).collect()
    assert got[0].s == 0 and got[-1].s == pytest.approx(1)
    assert all(r.again == pytest.approx(r.s, abs=1e-9) for r in got)
    assert all(r.u == pytest.approx(r.t, abs=1e-6) for r in got if not 0.75 <= r.t <= 0.875)
    with pytest.raises(ValueError):
        mixing.integrated(((0.0, 1.0), (0.5, 1.0)))


def test_mix_of_nothing(spark):
    placed, copies = mix_of(spark, [])
    assert placed.count() == 0 and copies.count() == 0
    placed, copies = mix_of(spark, [(1, None, "a"), (2, " ", None)])
    assert copies.count() == 0
    assert [(r.size, r.target, r.taken) for r in mixing.taken_words(placed, copies).collect()] == [(0, 0.0, 0)] * 2


def test_sources_are_ranked_by_code_point(spark):
    names = ["b", "a", "B", "é", "z", "", "日", "😀", "￿", None]
    docs = [(i, "w " * (i + 1), s) for i, s in enumerate(names)]
    placed, _ = mix_of(spark, docs)
    got = {r.source: r.weight for r in placed.collect()}
    order = sorted((s for s in names if s is not None)) + [None]
    assert got == {s: 1 + n % 3 for n, s in enumerate(order)}
