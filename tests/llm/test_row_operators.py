"""Jaccard join, chat formatting and WARC archives against plain Python."""

import base64
import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from contactloom.llm import chat_format, components, ngram_jaccard, storage, warc
from llm import brute

# --- near copies --------------------------------------------------------------------------------


def grouped(docs):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_jaccard.linked_groups(docs).collect()}


def test_groups(odd_docs, odd_texts):
    want = brute.groups(odd_texts)
    assert grouped(odd_docs) == want
    assert len({c for _, c in want.values()}) < len(want) - 40


def chains(seed):
    """Texts that drift, so that links reach far beyond similar texts, with sizes at the edge of 0.8."""
    rng = random.Random(seed)
    texts, words = [], [f"v{i}" for i in range(60)]
    for _ in range(6):
        now = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        for _ in range(25):
            now = list(now)
            if rng.random() < 0.5:
                now[rng.randrange(len(now))] = rng.choice(words)
            else:
                now.insert(rng.choice((0, len(now))), rng.choice(words))
            texts.append(" ".join(now).upper() if rng.random() < 0.2 else " ".join(now))
    rng.shuffle(texts)
    return dict(enumerate(texts))


@pytest.mark.parametrize("seed", [1, 2])
def test_chains_of_near_copies(spark, seed):
    texts = chains(seed)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    want = brute.groups(texts)
    assert grouped(docs) == want
    assert len({c for _, c in want.values()}) < len(want) - 30


def test_groups_of_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(4, text), (None, text), (None, None), (2, text + " more"), (9, "a b"), (9, text), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(ngram_jaccard.linked_groups(docs).collect(), key=str)
    assert [tuple(r) for r in got] == sorted(
        [(4, 36, 2), (2, 37, 2), (9, 36, 2), (7, 0, 7), (None, 36, None), (None, 0, None)], key=lambda r: f"Row(doc_id={r[0]}, n_shingles={r[1]}"
    )
    kept = ngram_jaccard.keep_one(docs)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["2", "7", "None", "None"]
    assert ngram_jaccard.linked_groups(docs.filter("doc_id > 99")).collect() == []


def test_texts_of_one_id_are_compared_each(spark):
    """Clashing, null and repeated ids: one row of each group stays, and no other text goes."""
    text, other, third = (" ".join(f"{c}{i}" for i in range(40)) for c in "wxy")
    rows = [(4, text, "a"), (2, text + " more", "a"), (9, "a b", "a"), (9, text, "a"), (5, other, "a"), (4, other + " q", "a"),
            (None, third, "a"), (None, third, "b"), (None, third + " z", "a"), (7, other, "b"), (7, other, "b"),
            (8, "c d e", "b"), (8, "c d e", "a"), (8, "c d e", "a"), (None, None, "a"), (None, None, "a"), (None, text, "a"), (3, " ", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    kept = [tuple(r) for r in ngram_jaccard.keep_one_row(docs).collect()]
    assert sorted((str(i), t) for i, t, _ in kept if i is not None) == sorted(
        [("2", text + " more"), ("4", other + " q"), ("9", "a b"), ("8", "c d e"), ("3", " ")]
    )
    unnamed = [t for i, t, _ in kept if i is None]
    assert unnamed.count(None) == 2 and len(unnamed) == 3 and unnamed[-1 if unnamed[-1] else 0 if unnamed[0] else 1].startswith(third)
    assert set(kept) <= set(rows)
    # the shorter text of 4 is a link of 5 and 7, and of 9 every text counts
    got = sorted(tuple(r) for r in ngram_jaccard.linked_groups(docs.filter("doc_id IS NOT NULL")).collect())
    assert got == [(2, 37, 2), (3, 0, 3), (4, 37, 2), (5, 36, 4), (7, 36, 4), (8, 1, 8), (9, 36, 2)]
    assert ngram_jaccard.keep_one_row(docs.filter("doc_id > 99")).collect() == []


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + rng.randint(1, 60)) for _ in range(50)] + [(7, 7), (None, 3), (300, 299), (299, 300)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert all(got[i] == 0 for i in range(41)) and got[300] == got[299] == 299
    assert all(got[b] == 100 for a, b in links if a == 100)


# --- chat ---------------------------------------------------------------------------------------


def test_chat(spark):
    rng = random.Random(4)
    parts = ["</s>", "<s>", "[INST]", "[/INST]", "[\\INST]", "<\\\\s>", "[ROLE]", "[/TURN]", "[TURN]", "\\", "<", "[", " ", "x", "é", "😀", "\n", "/s>"]
    rows = []
    for conv in range(12):
        for turn in range(rng.choice((1, 2, 5, 200))):
            text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
            rows.append((conv, turn, rng.choice(("user", "assistant", "assistant", "system", "[ROLE]")), text or None))
    rows += [(50, None, None, "null turn"), (50, 1, "assistant", None), (50, 1, "assistant", "tie"), (50, 1, "assistant", "tie"), (None, 0, "user", "x")]
    rng.shuffle(rows)
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    made = chat_format.chat(turns)
    read = chat_format.digests(made).collect()
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in read}
    convs = {}
    for conv, *rest in rows:
        convs.setdefault(conv, []).append(rest)
    assert got == {c: brute.chat_row(t) for c, t in convs.items()}
    for r in made.collect():
        assert sum(x.n_chars for x in r["loss_runs"]) == len(r["formatted"])
    assert chat_format.digests(chat_format.chat(turns.filter("conv_id > 99"))).collect() == []


def test_what_is_under_the_mask_counts(spark):
    """Digests follow the mask's places in the string, not the roles."""
    turns = spark.createDataFrame(
        [(1, 0, "user", "hé 😀 there"), (1, 1, "assistant", "</s>é"), (1, 2, "user", "and"), (1, 3, "assistant", "😀b")],
        "conv_id long, turn long, role string, text string",
    )
    made = chat_format.chat(turns)
    row = made.first()
    flat = [loss for r in row["loss_runs"] for loss in [r.loss] * r.n_chars]
    assert "".join(c for c, loss in zip(row["formatted"], flat) if loss) == "<\\/s>é😀b"
    right = chat_format.read_back(made).first()
    assert right["loss_text"] == "</s>é😀b"
    swapped = F.transform("loss_runs", lambda r: F.struct(r["n_chars"].alias("n_chars"), (~r["loss"]).alias("loss")))
    for wrong in (F.reverse("loss_runs"), swapped, F.concat(F.array(F.col("loss_runs")[1]), F.col("loss_runs"))):
        other = chat_format.digests(made.withColumn("loss_runs", wrong)).first()
        assert other["loss_sha256"] != chat_format.digests(made).first()["loss_sha256"]


def test_chat_format(spark):
    turns = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "a"), (1, 2, "assistant", "</s>")], "conv_id long, turn long, role string, text string")
    row = chat_format.chat(turns).first()
    assert row["formatted"] == "<s>[ROLE]user[/ROLE]hi</s><s>[ROLE]assistant[/ROLE]a[TURN]<\\/s></s>"


# --- archives -----------------------------------------------------------------------------------


def pages(spark):
    rows = [(i, f"http://h{i}/é?q=\r\n x", f"<p>page {i % 7}</p>" * (i % 5)) for i in range(60)]
    rows += [(70, None, None), (71, "u", ""), (None, "n", "<p>page 1</p>"), (None, "n", "alone"), (None, "n", "alone"), (5, "again", rows[5][2])]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)


def test_archive(spark):
    rows, df = pages(spark)
    first = {}
    for page_id, _, html in rows:
        key = html or ""
        if page_id is not None:
            first[key] = min(first.get(key, page_id), page_id)
    want = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        of = first.get(html or "")
        revisit = of is not None and of != page_id
        want.append((page_id, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", of if revisit else None))
    got = warc.archive(df, roll_bytes=600, shard_bytes=300).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_archive_is_deterministic(spark, tmp_path):
    _, df = pages(spark)
    found = []
    for n, part in (("a", 2), ("b", 7)):
        folder = f"{tmp_path}/{n}"
        warc.write_archive(df.repartition(part), folder, roll_bytes=600, shard_bytes=300)
        files = sorted((tmp_path / n).glob("*.warc.gz"))
        assert not list((tmp_path / n).glob("_temporary*"))
        found.append({f.name: f.read_bytes() for f in files})
    assert found[0] == found[1] and len(found[0]) > 3
    for data in found[0].values():
        assert gzip.decompress(data).startswith(b"WARC/1.1\r\nWARC-Type: ")
    ids = [r["page_id"] for r in warc.read_archive(spark.createDataFrame([(n,) for n in sorted(found[0])], "file string"), f"{tmp_path}/a").collect()]
    assert len(ids) == df.count()


def test_archive_of_nothing(spark):
    assert warc.archive(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_settling_twice(tmp_path):
    (tmp_path / "t").write_bytes(b"12")
    storage.settle(str(tmp_path), "t", "f", 2)
    storage.settle(f"file:{tmp_path}", "t", "f", 2)
    with pytest.raises(OSError):
        storage.settle(str(tmp_path), "t", "g", 2)
    with pytest.raises(OSError):
        storage.settle(str(tmp_path), "t", "f", 3)


# --- shards -------------------------------------------------------------------------------------


@pytest.mark.parametrize("ids", [
    [*range(1000), 10**12], [*range(0, 10**15, 10**12), -(2**63), 2**63 - 1], [5] * 1000, [*range(500), *[None] * 500], [None] * 300, [0], [],
])
def test_shards_are_level_wherever_the_ids_lie(spark, ids):
    docs = spark.createDataFrame([(i, f"t{n}") for n, i in enumerate(ids)], "doc_id long, text string").repartition(3)
    shard, tasks = storage.id_shards(docs, "doc_id", F.lit(84), 2_000, F.col("text"))
    rows = docs.select("doc_id", shard.alias("shard")).collect()
    assert all((r.doc_id is None) == (r.shard < 0) for r in rows)
    named = sorted((r.doc_id, r.shard) for r in rows if r.doc_id is not None)
    assert [s for _, s in named] == sorted(s for _, s in named)  # ranges of ids, in order
    assert all(len({s for i, s in named if i == x}) == 1 for x in set(ids[:5]) if x is not None)
    sizes = {}
    for r in rows:
        sizes[r.shard] = sizes.get(r.shard, 0) + 1
    if len(set(ids)) > 400:
        assert len(sizes) >= 50 or None in ids
        assert max(n for s, n in sizes.items() if s >= 0) <= 20  # of 100 bytes each
    if None in ids:
        assert sum(s < 0 for s in sizes) == ids.count(None) // 20 and max(n for s, n in sizes.items() if s < 0) < 60
    assert tasks >= len(sizes)


def test_token_files_and_archives_with_an_outlying_id(spark):
    from contactloom.llm import token_files
    from contactloom.llm.queries import tokenizer_file

    texts = {i: f"some words of {i}" for i in [*range(300), 10**12, -7]}
    docs = spark.createDataFrame([*texts.items(), (None, "no id"), (None, None)], "doc_id long, text string").repartition(4)
    rows = token_files.token_files(docs, tokenizer_file("word_bpe_49k.json"), shard_bytes=500).collect()
    assert sorted(r.doc_id for r in rows if r.doc_id is not None) == sorted(texts)
    assert sum(r.doc_id is None for r in rows) == 2
    ordered = sorted(rows, key=lambda r: r.start)
    assert [r.doc_id for r in ordered[2:]] == sorted(texts)
    assert all(a.start + a.n_tokens == b.start for a, b in zip(ordered, ordered[1:]))
    pages_ = spark.createDataFrame([(i, "u", t) for i, t in texts.items()], "page_id long, url string, html string")
    found = warc.archive(pages_, shard_bytes=500, roll_bytes=2_000).collect()
    assert sorted(r.page_id for r in found) == sorted(texts)
