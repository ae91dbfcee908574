"""Benchmark decontamination: broadcast sets of normalised test n-grams against all token windows.

A window is 13 consecutive words of a benchmark item; a shorter item is one window. Documents are
cut into windows row by row and joined with the broadcast windows on their full text, so a hit is
verified by the join itself. Benchmarks beyond the broadcast bound are read in blocks of hashed
windows, each within the bound, against all documents. DataFrame functions only.

Defined cases: null and empty texts have no words and are clean; items without words have no
windows; repeated items count once per item id, null item ids are left out of the id list but their
words are hit; repeated documents are each returned; empty tables give no hits or no rows; other
columns are kept out of the way, an input column named like a result is replaced.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactloom.llm.text import NON_ALNUM_ANY_CASE, alnum_word_count, alnum_words, boxed, let, row_key, whole
from contactloom.sources.shared import shared_table

WINDOW = 13
#: Text bytes of windows in one broadcast; about five times as much in memory.
BROADCAST_BYTES = 32_000_000

RESULTS = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hit_spans")


def _windows_of(words: Column, length: int) -> Column:
    return F.when(
        F.size(words) >= length,
        F.transform(
            F.sequence(F.lit(1), F.size(words) - (length - 1)),
            lambda p: F.array_join(F.slice(words, p, length), " "),
        ),
    ).otherwise(F.array().cast("array<string>"))


def benchmark_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """``(window, n, items)``: each distinct window once, its length in words, its items' ids."""
    words = benchmark.select(F.col(item).cast("string").alias("item"), alnum_words(F.col(text)).alias("words"))
    windows = let(
        F.col("words"),
        lambda w: F.when(F.size(w) >= WINDOW, _windows_of(w, WINDOW)).otherwise(
            F.array(F.array_join(w, " "))
        ),
    )
    return (
        words.filter(F.size("words") > 0)
        .select("item", F.least(F.size("words"), F.lit(WINDOW)).alias("n"), F.explode(windows).alias("window"))
        .groupBy("window", "n")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
    )


def window_hits(
    docs: DataFrame, windows: DataFrame, text: str = "text", id_col: str = "doc_id"
) -> DataFrame:
    """``(_id, _row, pos, n, items)`` of every place of every window in the documents.

    ``windows`` should be a stored table: its size and its window lengths (13 at most) are read
    first. Only hits leave the scan of the documents.
    """
    facts = windows.agg(
        F.sum(F.octet_length("window") + 8 + F.aggregate(
            "items", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x) + 8
        )).alias("bytes"),
        F.collect_set("n").alias("lengths"),
    ).first()
    lengths = sorted(facts["lengths"]) or [WINDOW]
    blocks = max(1, -(-(facts["bytes"] or 0) // BROADCAST_BYTES))
    keyed = docs.select(*row_key(id_col, text), alnum_words(F.col(text)).alias("words"))
    places = F.concat(*[
        F.transform(_windows_of(F.col("words"), n), lambda w, i: F.struct(
            w.alias("window"), F.lit(n).alias("n"), i.alias("pos")
        ))
        for n in lengths
    ])
    read = keyed.filter(F.size("words") >= lengths[0]).select("_id", "_row", F.inline(places))
    found = [
        read.join(
            F.broadcast(windows.filter(F.pmod(F.xxhash64("window"), F.lit(blocks)) == b)
                        if blocks > 1 else windows),
            ["window", "n"],
        )
        for b in range(blocks)
    ]
    return reduce(DataFrame.unionByName, found).select("_id", "_row", "pos", "n", "items")


def _spans(places: Column) -> Column:
    """Sorted ``(pos, n)`` -> ``(start, end)`` word spans that don't overlap, and the words in them."""
    first = F.struct(
        F.lit(0).alias("n"), F.lit(-1).alias("start"), F.lit(-1).alias("end"),
        F.array().cast("array<struct<start:int,end:int>>").alias("done"),
    )

    def step(a: Column, x: Column) -> Column:
        end = x["pos"] + x["n"]
        apart = x["pos"] > a["end"]
        return F.struct(
            (a["n"] + F.greatest(F.lit(0), end - F.greatest(x["pos"], a["end"]))).alias("n"),
            F.when(apart, x["pos"]).otherwise(a["start"]).alias("start"),
            F.greatest(a["end"], end).alias("end"),
            F.when(apart & (a["end"] > 0), F.concat(a["done"], F.array(F.struct(
                a["start"].alias("start"), a["end"].alias("end")
            )))).otherwise(a["done"]).alias("done"),
        )

    return F.aggregate(places, first, step, lambda a: F.struct(
        a["n"].alias("n"),
        F.concat(a["done"], F.array(F.struct(a["start"].alias("start"), a["end"].alias("end")))).alias("spans"),
    ))


def contamination(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", id_col: str = "doc_id",
    item: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """One row per document: ``id_col`` and RESULTS.

    ``hit_spans`` are the hit words as ``(start, end)``, end exclusive. A document is contaminated
    if it has a hit and at least a twentieth of its words are hit. Texts are never shuffled; what
    meets per document is its hits, distinct places only.
    """
    windows = shared_table(benchmark_windows(benchmark, item, item_text), "benchmark-windows")
    hits = (
        window_hits(docs, windows, text, id_col)
        .groupBy("_id", "_row")
        .agg(
            F.array_sort(F.collect_set(F.struct("pos", "n"))).alias("places"),
            F.collect_set("items").alias("items"),
        )
        .select(
            F.col("_id").alias("_hit_id"), F.col("_row").alias("_hit_row"),
            _spans(F.col("places")).alias("hit"),
            F.array_sort(F.array_distinct(F.flatten("items"))).alias("items"),
        )
    )
    measured = docs.select(*row_key(id_col, text), alnum_word_count(F.col(text)).cast("long").alias("n_words"))
    n_hit = F.coalesce(F.col("hit.n"), F.lit(0)).cast("long")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return (
        measured.join(
            hits, measured["_id"].eqNullSafe(hits["_hit_id"]) & (measured["_row"] == hits["_hit_row"]), "left"
        )
        .select(
            F.col("_id").alias(id_col), "n_words", n_hit.alias("n_hit"),
            F.size(items).cast("long").alias("n_items"),
            F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
            ((n_hit > 0) & (n_hit * 20 >= F.col("n_words"))).alias("contaminated"),
            F.coalesce("hit.spans", F.array().cast("array<struct<start:int,end:int>>")).alias("hit_spans"),
            F.col("_row"),
        )
    )


def cut_spans(text: Column, spans: Column) -> Column:
    """The text without the words of the spans and what stands between them; gaps become a space."""

    def of_parts(words_and_gaps: Column) -> Column:
        words, gaps = words_and_gaps["words"], words_and_gaps["gaps"]
        # gaps[i] stands before word i, the last gap after all words
        kept = F.aggregate(
            spans, F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
            lambda a, s: F.struct(
                s["end"].alias("at"),
                F.concat(a["out"], F.flatten(F.transform(
                    F.filter(F.sequence(a["at"], s["start"]), lambda i: i < s["start"]),
                    lambda i: F.array(gaps[i], words[i]),
                )), F.array(F.lit(" "))).alias("out"),
            ),
        )
        return let(kept, lambda k: F.array_join(F.concat(
            k["out"],
            F.flatten(F.transform(
                F.filter(F.sequence(k["at"], F.size(words)), lambda i: i < F.size(words)),
                lambda i: F.array(gaps[i], words[i]),
            )),
            F.array(gaps[F.size(words)]),
        ), ""))

    # Cut before lowering: words keep their case, and every gap is kept as it stands.
    body = whole(text)
    words = F.array_remove(F.split(body, NON_ALNUM_ANY_CASE), "")
    inner = F.split(body, "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
    parts = F.struct(words.alias("words"), inner.alias("gaps"))
    return F.when(F.size(spans) == 0, text).otherwise(let(parts, of_parts))


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", id_col: str = "doc_id",
    mode: str = "documents",
) -> DataFrame:
    """``docs`` without what the benchmark holds.

    ``mode="documents"`` drops contaminated documents and leaves the others as they are.
    ``mode="spans"`` keeps every document and cuts the hit words out of the contaminated ones.
    What was found is a table of known size, which Spark broadcasts if it is small.
    """
    found = contamination(docs, benchmark, text, id_col).filter("contaminated")
    keys = shared_table(
        found.select(F.col(id_col).alias("hit_id"), F.col("_row").alias("hit_row"), "hit_spans")
        .dropDuplicates(["hit_id", "hit_row"]), "contaminated",
    )
    rows = boxed(docs, id=F.col(f"`{id_col}`"), row=F.xxhash64(id_col, text))
    same = F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("row") == F.col("hit_row"))
    if mode == "documents":
        return rows.join(keys.drop("hit_spans"), same, "left_anti").select("_r.*")
    body = F.col(f"_r.`{text}`")
    cut = F.when(F.col("hit_spans").isNull(), body).otherwise(cut_spans(body, F.col("hit_spans")))
    return rows.join(keys, same, "left").select(
        *[cut.alias(c) if c == text else F.col(f"_r.`{c}`") for c in docs.columns]
    )
