"""Document quality with host-level rules.

Each document is measured once, row to row. Rule failures are counted per host, each host's failure
rate is shrunk towards the other hosts' by an empirical beta prior, and the host verdicts are
joined back. DataFrame functions only.

Defined cases: a null or empty text has no words and fails; null hosts are one host of their own;
repeated rows count and are returned as often as they stand; an empty table gives an empty table.
Columns of the input are kept; a measure replaces an input column of the same name.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactloom.llm.text import boxed, SPACES, let, spaced_words, whole
from contactloom.sources.shared import shared_table

WINDOW = 5


@dataclass(frozen=True)
class Rules:
    """Limits of the rules. The first two alone reject a document, the others only in a bad host."""

    min_words: int = 10
    max_repeat_percent: int = 20
    max_symbol_percent: int = 30  # symbols per 100 words
    max_dup_line_percent: int = 50  # repeated lines per 100 words
    min_word_chars_x10: int = 20  # mean word length, in tenths
    max_word_chars_x10: int = 200
    bad_host_rate: float = 0.5  # shrunk failure rate from which a host is bad


def _repeated_windows(words: Column) -> Column:
    """Words inside 5-word windows that stand twice or more, compared as strings."""

    def from_windows(windows: Column) -> Column:
        by_text = F.array_sort(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
        return let(by_text, from_sorted)

    def from_sorted(s: Column) -> Column:
        repeated = F.filter(
            F.transform(s, lambda x, k: F.when(
                (k > 0) & F.get(s, k - 1)["w"].eqNullSafe(x["w"]) | F.get(s, k + 1)["w"].eqNullSafe(x["w"]),
                x["i"],
            )),
            lambda i: i.isNotNull(),
        )
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        return F.aggregate(
            F.array_sort(repeated), start,
            lambda a, i: F.struct(
                (a["n"] + i + WINDOW - F.greatest(i, a["end"])).alias("n"), (i + WINDOW).alias("end")
            ),
            lambda a: a["n"],
        )

    windows = F.transform(
        F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)),
        lambda p: F.array_join(F.slice(words, p, WINDOW), " "),
    )
    return let(windows, from_windows)


def repeat_words(words: Column) -> Column:
    """Words in 5-word windows found twice or more in the text.

    Window hashes tell the texts without a repeated window, which are most; the others are
    compared exactly.
    """

    def hashed(h: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(h) - WINDOW),
            lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]),
        )

    hashes = let(F.transform(words, lambda w: F.xxhash64(w)), hashed)
    any_repeat = let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
    return F.when(F.size(words) <= WINDOW, 0).when(any_repeat, _repeated_windows(words)).otherwise(0)


def measures(text: str) -> Column:
    """Struct of the counts the rules use."""
    whole_text = whole(F.col(text))
    lines = F.filter(F.split(whole_text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))

    def of_words(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
            (F.char_length(whole_text) - F.char_length(F.regexp_replace(whole_text, "[#*$%&|<>]+", "")))
            .cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeat_words(words).cast("long").alias("n_repeat_words"),
        )

    return let(spaced_words(F.col(text)), of_words)


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def with_measures(docs: DataFrame, text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """Add the measures, ``base_failed`` and ``soft_failed``."""
    n = F.col("n_words")
    words_x10 = F.col("word_chars") * 10
    soft = (
        (F.col("n_symbols") * 100 > n * rules.max_symbol_percent)
        | (F.col("n_dup_lines") * 100 > n * rules.max_dup_line_percent)
        | (words_x10 < n * rules.min_word_chars_x10)
        | (words_x10 > n * rules.max_word_chars_x10)
    )
    others = [F.col(f"`{c}`") for c in docs.columns if c not in (*MEASURES, "base_failed", "soft_failed")]
    return (
        docs.select(F.struct(*others).alias("_r"), measures(text).alias("_m"))
        .select("_r.*", "_m.*")
        .withColumn(
            "base_failed",
            (n < rules.min_words)
            | (F.col("n_repeat_words") * 100 > n * rules.max_repeat_percent),
        )
        .withColumn("soft_failed", F.col("base_failed") | soft)
    )


def host_verdicts(measured: DataFrame, host: str, rules: Rules = Rules()) -> DataFrame:
    """``(host, n_docs, n_failed, failure_rate, host_failed)``, one row per host.

    Counts are summed before the shuffle, so a host with a third of all rows is a few rows of
    sums. The prior's two moments are the only values that come to the driver. The prior's weight
    is at least two documents, which keeps hosts of one document near the others' rate.
    """
    counts = shared_table(measured.groupBy(F.col(host).alias("host")).agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("soft_failed").cast("long")).alias("n_failed")
    ), "host-counts")
    rate = F.col("n_failed") / F.col("n_docs")
    moments = counts.agg(
        (F.sum("n_failed") / F.sum("n_docs")).alias("mean"), F.var_samp(rate).alias("var")
    ).first()
    mean, var = moments["mean"] or 0.0, moments["var"] or 0.0
    spread = mean * (1 - mean)
    weight = max(2.0, spread / var - 1) if var > 0 else max(2.0, 1e6 if spread else 2.0)
    shrunk = (F.col("n_failed") + F.lit(mean * weight)) / (F.col("n_docs") + F.lit(weight))
    return counts.select(
        "host", "n_docs", "n_failed", shrunk.alias("failure_rate"),
        (shrunk > rules.bad_host_rate).alias("host_failed"),
    )


def _judged(measured: DataFrame, verdicts: DataFrame, host: str) -> DataFrame:
    """Verdicts are a table of known size, joined by Spark's own choice: broadcast if small, else a join
    whose skewed hosts are split."""
    taken = ("failure_rate", "host_failed", "kept")
    rows = boxed(measured.select(*[F.col(f"`{c}`") for c in measured.columns if c not in taken]))
    return (
        rows.join(verdicts, F.col(f"_r.`{host}`").eqNullSafe(F.col("host")), "left")
        .select("_r.*", "failure_rate", "host_failed")
        .withColumn("kept", ~F.col("base_failed") & ~(F.col("host_failed") & F.col("soft_failed")))
    )


def judge_measured(measured: DataFrame, host: str = "source", rules: Rules = Rules()) -> DataFrame:
    """Measured rows with ``failure_rate``, ``host_failed`` and ``kept``.

    A document is rejected if it fails a base rule, or if its host is bad and it fails any rule.
    The measured rows are written once to the shared folder and read for the host counts (two
    columns) and for the verdicts; neither pass works on the texts again.
    """
    stored = shared_table(measured, "quality")
    return _judged(stored, shared_table(host_verdicts(stored, host, rules), "host-verdicts"), host)


def judge(
    docs: DataFrame, text: str = "text", host: str = "source", rules: Rules = Rules()
) -> DataFrame:
    """``docs`` with measures and verdicts."""
    return judge_measured(with_measures(docs, text, rules), host, rules)


def keep(docs: DataFrame, text: str = "text", host: str = "source", rules: Rules = Rules()) -> DataFrame:
    """The kept rows of ``docs``, columns unchanged.

    Texts are measured twice, for the hosts' counts and for the rows' own verdicts, so that they are
    neither stored nor shuffled.
    """
    beside = boxed(docs, text=F.col(f"`{text}`"), host=F.col(f"`{host}`")).withColumnRenamed("_r", "_row")
    verdicts = host_verdicts(with_measures(beside.drop("_row"), "text", rules), "host", rules)
    measured = with_measures(beside, "text", rules).drop("text")
    return _judged(measured, shared_table(verdicts, "host-verdicts"), "host").filter("kept").select("_row.*")
