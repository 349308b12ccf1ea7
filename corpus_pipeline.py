"""A corpus from raw documents to packed sequences: five stages, each on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskgraph.llm import language_id, mixing, ngram_join, packing, secrets
from riskgraph.llm.common import cut, table
from riskgraph.llm.queries import vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A text whose likeliest language is less likely than this is rejected.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language to tell; those without letters or with no likely language go. A null lang becomes the one told.

    Null and empty texts have no letter, and go. Repeated rows and null doc_ids stay; an empty table stays one.
    """
    out = language_id.identify(docs, language_id.learn(docs), keep=COLUMNS)
    out = out.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return out.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose word 5-grams are alike by 0.8 or more, step by step: that of the least doc_id.

    Of repeated rows one stays. Documents without words are alike to none, so they stay; an empty table stays one.
    """
    return ngram_join.one_of_each(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with its secrets masked. Null texts stay null, repeated rows stay; overlapping secrets are one mask."""
    return secrets.redacted(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the proportions of the sources' weights, repeated or left out as that takes.

    A null source is one source; documents without words count nothing and stay. Ties of doc_id fall by a hash of the row.
    """
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens, with the ids in them. A null or empty text is its end token alone."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("language identification", language),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scan", without_secrets),
    ("mixing to target weights", mixed),
    ("packing", packed),
]
#: No SQL computes byte-pair pieces or a trained classifier; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
