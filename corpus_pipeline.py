"""The training-data pipeline: documents in, token ids of the documents worth training on out.

Stages, each over all rows its predecessor kept:

1. quality          documents that fail a rule, or any rule in a bad host, go
2. near_duplicates  one row of each group of near copies stays, the one with the smallest id
3. decontaminate    documents with a twentieth of their words from benchmark windows go
4. pii              personal data in the texts is replaced by its kind
5. tokenize         piece ids of every text

All but the last return the columns of ``documents``, with ``n_chars`` of the text as it then is.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactloom.llm import decontaminate as benchmark_windows
from contactloom.llm import ngram_jaccard, pii, queries, sentencepiece
from contactloom.llm import quality as quality_rules
from contactloom.sources.shared import shared_table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_jaccard.keep_one_row(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return benchmark_windows.decontaminate(docs, queries.table(spark, sf_dir, "benchmark"))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    redacted = pii.redact(docs)
    return redacted.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, lang, source, n_tokens, token_ids)``."""
    encoded = sentencepiece.encode(
        docs.select("doc_id", "lang", "source", "text"), queries.tokenizer_file("piece_bpe_32k.model")
    )
    return encoded.select("doc_id", "lang", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids")


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("pii", redact_pii),
    ("tokenize", tokenize),
]

#: The last stage and the redaction can't be said in SQL; the tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = shared_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
SQL: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
