"""License scans, decontamination, personal data and quality rules against plain Python."""

import re
import pytest
from pyspark.sql import functions as F

from contactloom.llm import decontaminate, license_scan, ngram_jaccard, pii, quality
from llm import brute

LICENSE = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def by_id(df, columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.select("doc_id", *columns).collect()}


def test_license_scan(odd_docs, odd_texts):
    templates = license_scan.prepared()
    want = {i: brute.license_row(t, templates, license_scan.BASE_PHRASES) for i, t in odd_texts.items()}
    assert by_id(license_scan.scan(odd_docs), LICENSE) == want
    assert any(w[5] for w in want.values())


@pytest.mark.parametrize("percent", [50, 70, 100])
def test_license_thresholds(spark, percent):
    """Blocks at every containment, so that each filter is at its edge."""
    from fractions import Fraction

    notice = "permission is hereby granted free of charge to any person".split()
    rows = [(i, " ".join(notice[j] for j in range(len(notice)) if i >> j & 1) + "\nother line") for i in range(0, 1024, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    templates = (("mit", " ".join(notice)), ("short", "free of charge"))
    share = Fraction(percent, 100)
    got = by_id(license_scan.scan(docs, templates=templates, threshold=share), LICENSE)
    made = license_scan.prepared(templates, share)
    assert got == {i: brute.license_row(t, made, license_scan.BASE_PHRASES) for i, t in rows}


def test_license_edges(spark, no_docs):
    assert license_scan.scan(no_docs).collect() == []
    docs = spark.createDataFrame([(None, "All rights reserved"), (None, None), (3, "x"), (3, "x"), (3, "cc by")], "doc_id long, text string")
    got = sorted(map(str, license_scan.scan(docs).select("doc_id", "n_base", "labels").collect()))
    assert got == sorted([
        "Row(doc_id=None, n_base=1, labels='reserved')", "Row(doc_id=None, n_base=0, labels='')",
        "Row(doc_id=3, n_base=0, labels='')", "Row(doc_id=3, n_base=0, labels='')", "Row(doc_id=3, n_base=1, labels='cc-by')",
    ])


MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal"
BSD = """# Redistribution and use in source and binary forms, with or without modification,
# are permitted provided that the following conditions are met:"""
MPL = "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed */"
CC0 = "dnl To the extent possible under law, the author has waived all\ndnl copyright and related or neighboring rights to this\ndnl work"


def test_wrapped_notices(spark, monkeypatch):
    """A notice is found wherever its lines end and wherever it stands; scattered words are none."""
    filler = " ".join(f"f{i}" for i in range(60))
    words = MIT.replace("\n", " ").split()
    texts = [MIT, f"Copyright\n\n{BSD}\nx", f"{MPL}\n{MIT}", CC0, MIT.replace(" ", "\n"), "all\nrights\n\nreserved", f"\n{filler}\n".join(words)]
    want = ["mit", "bsd", "mit,mpl-2.0", "cc0", "mit", "reserved", ""]
    texts += [" ".join(f"f{i}" for i in range(n)) + f"\n{MIT}\n" + filler for n in range(25)]
    want += ["mit"] * 25
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for size in (license_scan.PIECE_WORDS, 16):  # in pieces the result is the same
        monkeypatch.setattr(license_scan, "PIECE_WORDS", size)
        got = by_id(license_scan.scan(docs), ["labels", "score"])
        assert [got[i][0] for i in range(len(texts))] == want
        assert got[0][1] == got[1][1] == got[7][1] == 1.0 and got[6][1] == 0.0


# --- decontamination ----------------------------------------------------------------------------

HITS = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


@pytest.fixture(scope="module")
def items(odd_texts):
    long = [t for t in odd_texts.values() if t and len(t.split()) > 40]
    cut = [" ".join(t.split()[k : k + 15 + k]) for k, t in enumerate(long[:8])]
    return [*enumerate([None, "", "...", "Two WORDS", "w1 w2", *cut, cut[0], cut[1].upper()]), (None, cut[2]), (5, cut[3])]


def test_contamination(spark, odd_docs, odd_texts, items, monkeypatch):
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = {i: brute.contamination_row(t, items) for i, t in odd_texts.items()}
    assert by_id(decontaminate.contamination(odd_docs, benchmark), HITS) == want
    assert 3 < sum(w[4] for w in want.values()) < len(want)
    # in blocks the result is the same
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 2_000)
    assert by_id(decontaminate.contamination(odd_docs, benchmark), HITS) == want


def test_contamination_edges(spark, odd_docs, no_docs, odd_texts, items):
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert all(r[1] == 0 and not r[4] for r in by_id(decontaminate.contamination(odd_docs, nothing), HITS).values())
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    assert decontaminate.contamination(no_docs, benchmark).collect() == []
    twice = spark.createDataFrame([(None, "two words"), (None, "two words"), (1, None)], "doc_id long, text string")
    got = sorted(map(str, decontaminate.contamination(twice, benchmark).select("doc_id", "n_hit").collect()))
    assert got == ["Row(doc_id=1, n_hit=0)", *["Row(doc_id=None, n_hit=2)"] * 2]
    kept = decontaminate.decontaminate(odd_docs, benchmark)
    assert kept.columns == odd_docs.columns
    bad = {i for i, t in odd_texts.items() if brute.contamination_row(t, items)[4]}
    assert {r["doc_id"] for r in kept.collect()} == odd_texts.keys() - bad


def test_spans_are_cut(spark):
    item = " ".join(f"k{i}" for i in range(13))
    docs = spark.createDataFrame(
        [(1, f"Before, it: {item.upper()}! After"), (2, "clean Text"), (3, item), (4, f"{item} mid {item}")], "doc_id long, text string"
    )
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(docs, benchmark, mode="spans").collect()}
    assert got[1].startswith("Before, it") and got[1].endswith("! After") and "K" not in got[1]
    assert got[2] == "clean Text"
    assert got[3].strip() == "" and got[4].split() == ["mid"]


# --- personal data ------------------------------------------------------------------------------


def listed(rows):
    return {r["doc_id"]: [f"{s.kind}:{s.start}:{s.end}" for s in r["pii"]] for r in rows}


def test_base_spans(odd_docs, odd_texts):
    base = [k.name for k in pii.KINDS if k.base]
    got = {i: [s for s in spans if s.split(":")[0] in base] for i, spans in listed(pii.find(odd_docs).collect()).items()}
    assert got == {i: brute.base_spans(t) for i, t in odd_texts.items()}
    assert {s.split(":")[0] for spans in got.values() for s in spans} == set(base)


def test_added_kinds_and_scores(spark):
    texts = [
        "bank account DE89 3704 0044 0532 0130 00", "bank account DE88 3704 0044 0532 0130 00", "GB82WEST12345698765432",
        "token = 0b96a8c8d79c4a5085c919698889f59b72ab7bb6", "commit 0b96a8c8d79c4a5085c919698889f59b72ab7bb6",
        "his ssn 123-45-6789", "part 123-45-6789", "ssn 000-45-6789",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    rows = pii.find(docs).orderBy("doc_id").collect()
    assert [[s.kind for s in r["pii"] if s.kind in ("iban", "ssn", "secret")] for r in rows] == [
        ["iban"], [], ["iban"], ["secret"], [], ["ssn"], [], []
    ]
    assert rows[0]["pii"][0].score > rows[2]["pii"][0].score
    assert pii.find(docs.filter("doc_id < 0")).collect() == []


def test_context_is_the_text_around_a_span(spark, odd_docs, odd_texts):
    """Also across other matches: a list of numbers has its heading near."""
    listed_twice = ["SSN: 123-45-6789, 234-56-7891", "ssn 123-45-6789 " + "x" * 23 + " 234-56-7891", "1 2 3-4 5 6 7 phone 8 4111111111111111",
                    "key " + "0b96a8c8d79c4a5085c919698889f59b72ab7bb6 " * 3, "ip" + " 1.2.3.4" * 6]
    texts = [*(t or "" for t in odd_texts.values()), *listed_twice]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(4)
    kinds = {k.name: k for k in pii.KINDS}
    raised = 0
    for row in pii.find(docs).collect():
        for s in row["pii"]:
            kind, text = kinds[s.kind], texts[row["doc_id"]]
            near = f"{text[max(0, s.start - pii.CONTEXT_CHARS) : s.start]} {text[s.end : s.end + pii.CONTEXT_CHARS]}".lower()
            bonus = pii.CONTEXT_BONUS if re.search(kind.words, near) else 0
            assert s.score == pytest.approx(min(1.0, kind.score + bonus)), (text, s)
            raised += bool(bonus)
    assert raised > 10
    redacted = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert redacted[len(odd_texts)] == "SSN: [SSN], [SSN]"
    assert redacted[len(odd_texts) + 3].split() == ["key", "[SECRET]", *["0b96a8c8d79c4a5085c919698889f59b72ab7bb6"] * 2]


def test_redaction(odd_docs, odd_texts):
    found = {r["doc_id"]: r["pii"] for r in pii.find(odd_docs).collect()}
    redacted = pii.redact(odd_docs)
    assert redacted.columns == odd_docs.columns
    for row in redacted.collect():
        text, at, out = odd_texts[row["doc_id"]], 0, []
        if not found[row["doc_id"]]:
            assert row["text"] == text
            continue
        for s in found[row["doc_id"]]:
            if s.start >= at:
                out.append(text[at : s.start] + f"[{s.kind.upper()}]")
            at = max(at, s.end)
        assert row["text"] == "".join(out) + text[at:]


def test_patterns_are_linear(spark):
    """Long runs that no pattern matches."""
    runs = ["a" * 300_000, "1" * 300_000, "1." * 150_000, "a@" * 150_000, "+1" * 150_000, "+1" + " " * 300_000, "A1" * 150_000, "1 " * 150_000]
    docs = spark.createDataFrame(list(enumerate(runs)), "doc_id int, text string")
    assert len(pii.find(docs).select("doc_id", F.size("pii")).collect()) == len(runs)


# --- quality ------------------------------------------------------------------------------------

MEASURED = [*quality.MEASURES, "base_failed"]


def test_measures(odd_docs, odd_texts):
    got = by_id(quality.with_measures(odd_docs), MEASURED)
    assert got == {i: brute.quality_row(t) for i, t in odd_texts.items()}
    assert any(0 < w[4] < w[0] for w in got.values())


def test_hosts(spark):
    """A host of failing documents takes its doubtful ones along, not its clean ones."""
    clean = " ".join(f"word{i}" for i in range(40))
    doubtful = clean + " " + " ".join(f"x{i}##$$" for i in range(20))
    rows = [(i, "bad", "too few") for i in range(30)] + [(100, "bad", doubtful), (101, "bad", clean)]
    rows += [(200 + i, f"good{i % 5}", clean) for i in range(200)] + [(500, "good1", doubtful), (501, None, clean), (502, "one", "few")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    judged = {r["doc_id"]: r for r in quality.judge(docs).collect()}
    assert [judged[i]["kept"] for i in (0, 100, 101, 200, 500, 501, 502)] == [False, False, True, True, True, True, False]
    assert judged[100]["host_failed"] and not judged[500]["host_failed"] and not judged[502]["host_failed"]
    kept = quality.keep(docs)
    assert kept.columns == docs.columns and kept.count() == 203


def test_quality_edges(odd_docs, odd_texts, no_docs, spark):
    assert quality.judge(no_docs).collect() == []
    kept = quality.keep(odd_docs)
    assert kept.columns == odd_docs.columns
    good = {i for i, t in odd_texts.items() if not brute.quality_row(t)[5]}
    assert {r["doc_id"] for r in kept.collect()} <= good
    twice = spark.createDataFrame([(None, "a", "x"), (None, "a", "x")], "doc_id long, text string, source string")
    assert quality.judge(twice).count() == 2


# --- names of results as columns of the input -----------------------------------------------------


def test_columns_named_like_the_operators_own(spark, benchmark_of_clashes):
    names = ["_m", "_host", "host", "_r", "_row", "_id", "_hit_id", "hit_id", "hit_row", "_hit_row", "_spans", "hit_spans",
             "_gone", "_alive", "id", "row", "node", "key", "token", "failure_rate", "component", "n"]
    words = " ".join(f"w{i}" for i in range(40))
    rows = [(i, f"{words} own {i // 2}", "s") for i in range(4)] + [(9, "short", None)]
    schema = "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names)
    docs = spark.createDataFrame([(*r, *[f"{n}{r[0]}" for n in names]) for r in rows], schema)

    def same(kept):
        assert kept.columns == docs.columns
        assert all(tuple(r)[3:] == tuple(f"{n}{r.doc_id}" for n in names) for r in kept.collect())
        return sorted(r.doc_id for r in kept.collect())

    judged = quality.judge(docs)
    assert [c for c in docs.columns if c not in judged.columns] == []
    assert all(r._host == f"_host{r.doc_id}" and r._m == f"_m{r.doc_id}" for r in judged.collect())
    assert same(quality.keep(docs)) == [0, 1, 2, 3]
    assert same(ngram_jaccard.keep_one_row(docs)) == [0, 9]
    assert same(ngram_jaccard.keep_one(docs)) == [0, 9]
    for mode in ("documents", "spans"):
        left = same(decontaminate.decontaminate(docs, benchmark_of_clashes, mode=mode))
        assert left == ([9] if mode == "documents" else [0, 1, 2, 3, 9])


@pytest.fixture(scope="module")
def benchmark_of_clashes(spark):
    text = " ".join(f"w{i}" for i in range(5, 25))
    return spark.createDataFrame([(1, text, "x")], "item_id long, text string, _hit_id string")
