"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again.

Every stage works on all rows its predecessor kept; all but the last keep the columns of the documents, whatever
their names, and an empty table stays empty.  Near duplicates share at least 0.8 of their
five-word shingles (Jaccard similarity).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobmarket.llm.bpe import encode
from jobmarket.llm.common import delete_path, shipping, staged, table, work_path
from jobmarket.llm.jaccard import keep_one
from jobmarket.llm.mixing import mix
from jobmarket.llm.substrings import remove_repeats
from jobmarket.llm.toxicity import fit, keep_clean


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold, by a classifier trained on the labelled ones.

    Null and empty texts score 0 and stay; without labels of both kinds all stay.  Repeated rows repeat.
    """
    return keep_clean(docs, fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates (smallest doc_id).

    Texts without words, null ones among them, are one group.  Repeated rows of a doc_id stay or go together; rows
    without doc_id stay.
    """
    return keep_one(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a document with a smaller doc_id has too; a text may become empty.

    Null texts become empty; rows without doc_id keep their text.
    """
    return remove_repeats(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that all sources weigh the same, in a global random order.

    A null source is a source of its own; texts are not looked at.
    """
    # columns are carried under a name of their own, as the mix has columns too
    return mix(docs.select("doc_id", "source", F.struct(*docs.columns).alias("__row"))).select("__row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the text decoded from them, one row per document of the mix; a null text has no tokens."""
    return encode(docs, ids=True, decoded=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", shipping(toxicity)),
    ("near_duplicates", shipping(near_duplicates)),
    ("substrings", shipping(substrings)),
    ("mixing", shipping(mixing)),
    ("tokens", shipping(tokens)),
]

#: no SQL: it can't state the classifier, the fingerprints or the tokenizer
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; a stage's table is removed when the next one is written."""
    docs, previous = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        path = work_path(spark)
        docs = staged(stage(spark, docs, sf_dir), path)
        if previous:
            delete_path(spark, previous)
        previous = path
    return docs
