"""A training-data pipeline over ``documents`` in five stages, each one of the operators of ``corpusloom.llm``.

``run(spark, sf_dir)`` applies the stages in order; each reads the Parquet that
the one before wrote.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import mixing, packing, setsketch, substring, toxicity
from corpusloom.llm.common import free_names, write_table
from corpusloom.llm.queries import table, vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts toxic go; it learns from the labels outside the held-out fold.

    Whole texts are scored. Null and empty texts have the score of a text without features; rows with the same text stay or
    go together, whatever their ids, null ones too; without labels of both classes nothing goes unless all labels say toxic; an empty
    table stays empty; other columns pass through under any name.
    """
    (name,) = free_names(docs.columns, "_toxicity")
    model = toxicity.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, docs.columns, name).filter(F.col(name) < 0.5).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one with the smallest id: five-word shingles, similarity 0.8.

    Null and empty texts are in no group and stay, as do rows with a null id. Rows that repeat an id are one
    document: they stay or go together, by the group of all their texts. Texts are compared whole; an empty table
    stays empty; other columns pass through under any name.
    """
    (gone,) = free_names(docs.columns, "_gone")
    found = setsketch.near_duplicates(docs.select("doc_id", "text"), shingle=5, percent=80).filter("not kept").select(F.col("doc_id").alias(gone))
    return docs.join(found, F.col("doc_id") == F.col(gone), "left_anti")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that a document with a smaller id holds go.

    A text that loses words becomes its kept words joined by one space, and n_chars follows; a document that loses all goes. Null, empty
    and shorter texts and rows with a null id stay as they are; rows that repeat an id aren't compared with each
    other; an empty table stays empty; other columns pass through under any name.
    """
    return substring.dedup_texts(docs, window=50)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes their words: remainders are rounded without bias, so each source keeps its target.

    Documents without words take no words and go. A null source is a source of its own. Rows with null or repeated ids
    are separate rows; equal ones are told apart by a row number. An empty table stays empty; other
    columns pass through under any name.
    """
    return mixing.repeat_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 1024 ids, neighbours along a space-filling curve together.

    Null and empty texts hold just the end id; a text of any length is cut into pieces; rows that repeat an id, or have none, are
    packed each; an empty table gives no pieces; other columns are ignored.
    """
    return packing.pack(packing.encode(docs, vocabulary("byte_bpe_50k.json")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near-duplicates", drop_near_duplicates),
    ("substrings", cut_repeats),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can't express the trained classifier nor the tokenizer; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
