"""One query per operator over its whole table, and the SQL of those that SQL can express."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactloom.llm import (
    chat_format, decontaminate, license_scan, mixing, ngram_jaccard, pii, prefix_trie, quality, ranked_search,
    sentencepiece, token_counts, token_files, warc,
)
from contactloom.llm.oracle import oracle_sql
from contactloom.sources.shared import shared_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """Place of a public tokenizer's file; the same on every machine of a cluster."""
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text")


@query
def op1_license_scan(spark, sf):
    return license_scan.scan(documents(spark, sf))


@query
def op2_token_counts(spark, sf):
    return token_counts.token_counts(documents(spark, sf), tokenizer_file("word_bpe_49k.json"))


@query
def op3_ngram_jaccard(spark, sf):
    return ngram_jaccard.linked_groups(documents(spark, sf))


@query
def op4_decontamination(spark, sf):
    found = decontaminate.contamination(documents(spark, sf), table(spark, sf, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query
def op5_sentencepiece(spark, sf):
    return sentencepiece.digests(documents(spark, sf), tokenizer_file("piece_bpe_32k.model"))


@query
def op6_pii(spark, sf):
    found = pii.find(documents(spark, sf))
    base = [k.name for k in pii.KINDS if k.base]
    counts = [F.size(F.filter("pii", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}") for k in base]
    return found.select(
        "doc_id", *counts,
        F.sha2(pii.listed(F.filter("pii", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        pii.listed(F.col("pii")).alias("spans"),
    )


@query
def op7_quality(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "source")
    measured = quality.judge_measured(quality.with_measures(docs).drop("text"))
    return measured.select("doc_id", *quality.MEASURES, "base_failed", "kept", "host_failed", "soft_failed")


@query
def op8_chat_format(spark, sf):
    said = "</s>[INST] ok [/INST]"
    odd = spark.sql(
        "SELECT conv_id, turn, role, :said AS text FROM VALUES (-7L, 0L, 'user'), (-7L, 1L, 'assistant') t(conv_id, turn, role)",
        args={"said": said},
    )
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").unionByName(odd)
    return chat_format.digests(chat_format.chat(turns))


@query
def op9_warc(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url", "html")
    return warc.archive(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op10_token_files(spark, sf):
    return token_files.token_files(documents(spark, sf), tokenizer_file("word_bpe_49k.json"), end_id=2)


@query
def op11_ranked_search(spark, sf):
    return ranked_search.search(documents(spark, sf), table(spark, sf, "benchmark"))


@query
def op12_prefix_trie(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    return prefix_trie.trie(*prefix_trie.branched(prefix_trie.placed(turns)))


@query
def op13_mixing(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "source")
    placed = mixing.streams(docs)
    mixed = shared_table(mixing.mix(placed), "mix")
    return mixing.taken_words(placed, mixed).drop("first_time")


SQL = oracle_sql()
