"""License scans: an exact set-similarity join between text blocks and license templates.

A block is a window of consecutive words wherever it lies, over line ends too, so that a wrapped
notice is compared as a whole; its tokens are its distinct words. A template's windows have as
many words as the template and a quarter more, for words that lines of comments begin with, so a
template's words strewn over a long line are no notice. A
template is found in a block when the block holds at least ``threshold`` of the template's distinct
tokens. Tokens are ordered by their
document frequency in the whole corpus, rarest first; tokens of no template come last, where they
cannot matter. A template with m tokens that needs o of them must share one of its m - o + 1 rarest
(prefix filter); the block needs o template tokens at all (length filter); and the tokens after
the first shared ones must be able to make up o (positional filter). Every pair that passes is
verified, so no block that meets the threshold is missed. Only windows around a token of a prefix
are looked at, and of those, the ones that begin with a token of the template. Licence names at fixed places ("base"
phrases) are looked up beside it. DataFrame functions only.

Defined cases: null and empty texts have no words, no labels and score 0; repeated rows are each
returned; an empty table gives an empty table.
"""

from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactloom.llm.text import alnum_words, let, row_key
from contactloom.sources.shared import shared_table

#: Phrases whose words stand consecutively, and their labels.
BASE_PHRASES = (
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
)

#: (label, notice). Public licence notices, in the short forms that texts carry.
TEMPLATES = (
    ("agpl", "licensed under the GNU Affero General Public License"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("lgpl", "licensed under the GNU Lesser General Public License"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("reserved", "All rights reserved"),
)
THRESHOLD = Fraction(9, 10)
#: Words that are looked at in one row; a longer text is read in overlapping pieces.
PIECE_WORDS = 4096


@dataclass(frozen=True)
class Template:
    label: str
    tokens: tuple[str, ...]  # distinct
    needed: int
    window: int  # words


def prepared(templates=TEMPLATES, threshold: Fraction = THRESHOLD) -> list[Template]:
    """Templates as token sets with the number of tokens that meets the threshold."""
    out = []
    for label, notice in templates:
        lowered = "".join(c.lower() if c.isascii() else c for c in notice)
        words = "".join(c if c.isalnum() or not c.isascii() else " " for c in lowered).split()
        tokens = tuple(dict.fromkeys(words))
        needed = -(-len(tokens) * threshold.numerator // threshold.denominator)
        out.append(Template(label, tokens, needed, len(words) + len(words) // 4))
    return out


def _texts(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def phrase_places(words: Column, phrases=BASE_PHRASES) -> Column:
    """Array of ``(label, start)``, one for every place of every phrase."""
    found = []
    for phrase, label in phrases:
        parts = phrase.split()
        at = F.filter(
            F.sequence(F.lit(0), F.size(words) - 1),
            lambda i: F.forall(
                F.array(*[F.get(words, i + k).eqNullSafe(F.lit(p)) for k, p in enumerate(parts)]), lambda x: x
            ),
        )
        found.append(
            F.when(
                F.array_contains(words, parts[0]) & F.array_contains(words, parts[-1]),
                F.transform(at, lambda i: F.struct(F.lit(label).alias("label"), i.alias("start"))),
            ).otherwise(F.array().cast("array<struct<label:string,start:int>>"))
        )
    return F.concat(*found)


def token_order(seen: DataFrame, vocabulary: list[str]) -> list[str]:
    """The template tokens, rarest first, by the number of documents that hold them.

    ``seen`` has one array of template tokens per document. What comes to the driver is one count
    per template token.
    """
    counts = dict(
        seen.select(F.explode("seen").alias("token")).groupBy("token").count().collect()
    )
    return sorted(vocabulary, key=lambda t: (counts.get(t, 0), t))


def matching_windows(
    docs: DataFrame, order: list[str], prefixes: DataFrame, rare: list[str], longest: int, text: str, id_col: str
) -> DataFrame:
    """``(_id, _row, label, score)`` around every prefix token whose windows meet a template's threshold.

    ``longest`` is the length of the longest template's windows. Words are read in pieces that
    overlap by that much on both sides; a prefix token counts in the piece whose middle it stands in.
    """
    rare_ranks = F.array(*[F.lit(order.index(t)) for t in rare])

    def pieces(words: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(words) - 1) / PIECE_WORDS).cast("int"))
        return F.transform(starts, lambda k: let(
            F.greatest(k * PIECE_WORDS - longest, F.lit(0)),
            lambda begin: F.struct(
                (k * PIECE_WORDS - begin).alias("own"),
                F.slice(words, begin + 1, (k + 1) * PIECE_WORDS + longest - begin).alias("words"),
            ),
        ))

    places = F.filter(
        F.transform("piece.words", lambda w, i: F.struct(
            i.alias("at"), (F.array_position(_texts(order), w) - 1).cast("int").alias("token")
        )),
        lambda x: x["token"] >= 0,
    )

    def around(found: Column) -> Column:
        own = F.filter(
            F.transform(found, lambda x, i: F.struct(x["at"].alias("at"), x["token"].alias("token"), i.alias("i"))),
            lambda x: F.array_contains(rare_ranks, x["token"])
            & (x["at"] >= F.col("piece.own")) & (x["at"] < F.col("piece.own") + PIECE_WORDS),
        )
        return F.transform(own, lambda x: F.struct(
            x["at"].alias("at"), x["token"].alias("token"),
            F.slice(found, F.greatest(x["i"] - longest, F.lit(0)) + 1, F.lit(2 * longest + 1)).alias("near"),
        ))

    def tokens(found: Column) -> Column:
        return F.array_distinct(F.transform(found, lambda x: x["token"]))

    own_tokens = F.filter("near", lambda x: F.array_contains("t_tokens", x["token"])
                          & (F.abs(x["at"] - F.col("at")) < F.col("window")))
    in_windows = F.transform(
        F.filter("near", lambda x: x["at"] <= F.col("at")),
        lambda first: F.size(tokens(F.filter(
            "near", lambda x: (x["at"] >= first["at"]) & (x["at"] < first["at"] + F.col("window"))
        ))),
    )
    return (
        docs.filter(F.arrays_overlap(alnum_words(F.col(text)), _texts(rare)))
        .select(*row_key(id_col, text), F.explode(let(alnum_words(F.col(text)), pieces)).alias("piece"))
        .filter(F.arrays_overlap("piece.words", _texts(rare)))
        .select("_id", "_row", F.explode(let(places, around)).alias("p"))
        .select("_id", "_row", "p.*")
        .join(F.broadcast(prefixes), "token")
        .withColumn("near", own_tokens)
        .filter(F.size(tokens(F.filter("near", lambda x: x["token"] >= F.col("token")))) >= F.col("needed"))
        .withColumn("shared", F.array_max(in_windows))
        .filter(F.col("shared") >= F.col("needed"))
        .select("_id", "_row", "label", (F.col("shared") / F.col("t_size")).alias("score"))
    )


def matching_blocks(
    docs: DataFrame, order: list[str], templates: list[Template], text: str, id_col: str
) -> DataFrame:
    """``(_id, _row, label, score)`` of windows that meet a template's threshold."""
    spark = docs.sparkSession
    rank = {t: i for i, t in enumerate(order)}
    index = []  # one row per template and prefix token; its size is that of the template list
    for n, t in enumerate(templates):
        ranks = sorted(rank[x] for x in t.tokens)
        for i, r in enumerate(ranks[: len(ranks) - t.needed + 1]):
            index.append((r, n, t.label, i, len(ranks), t.needed, t.window, ranks))
    prefixes = spark.createDataFrame(
        index,
        "token int, template int, label string, t_pos int, t_size int, needed int, window int, t_tokens array<int>",
    )
    rare = [order[r] for r in sorted({row[0] for row in index})]
    return matching_windows(docs, order, prefixes, rare, max(t.window for t in templates), text, id_col)


def scan(
    docs: DataFrame, text: str = "text", id_col: str = "doc_id", templates=TEMPLATES,
    threshold: Fraction = THRESHOLD, phrases=BASE_PHRASES,
) -> DataFrame:
    """One row per document: ``id_col``, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``score`` is 1 where a base phrase stands, else the largest containment found, else 0. Texts
    are read twice and never shuffled: once for what is counted per document and for the token
    frequencies, then for the windows of documents that hold a prefix token. Only found labels meet
    per document.
    """
    wanted = prepared(templates, threshold)
    vocabulary = sorted({w for t in wanted for w in t.tokens})

    def of_words(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"), phrase_places(words, phrases).alias("places"),
            F.array_intersect(_texts(vocabulary), words).alias("seen"),
        )

    read = shared_table(
        docs.select(*row_key(id_col, text), let(alnum_words(F.col(text)), of_words).alias("_f"))
        .select("_id", "_row", "_f.*"),
        "license-words",
    )
    order = token_order(read, vocabulary)
    found = (
        matching_blocks(docs, order, wanted, text, id_col)
        .groupBy("_id", "_row")
        .agg(F.collect_set("label").alias("found"), F.max("score").alias("best"))
        .select(F.col("_id").alias("_f_id"), F.col("_row").alias("_f_row"), "found", "best")
    )
    starts = F.transform("places", lambda p: p["start"])
    base = F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"])))
    both = F.array_sort(F.array_union(base, F.coalesce("found", F.array().cast("array<string>"))))
    return read.join(
        found, read["_id"].eqNullSafe(found["_f_id"]) & (read["_row"] == found["_f_row"]), "left"
    ).select(
        F.col("_id").alias(id_col), "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join(both, ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
