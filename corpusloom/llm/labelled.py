"""Bounded samples of labelled rows, shared by the operators that learn from ``labels``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import id_hash, spread, write_table

#: No score may use the labels of these rows: crc32(id as text) mod FOLDS = 0.
FOLDS = 5


def held_out(column: str = "doc_id") -> Column:
    """True for the held-out fold; false for the rest and for null ids."""
    return F.coalesce(id_hash(column, FOLDS) == 0, F.lit(False))


def training_labels(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label int) outside the held-out fold, one row per id; null ids and labels are no examples."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out())
    return known.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label"))


def sampled(df: DataFrame, classes: dict[int, int], per_class: int, seed: int) -> DataFrame:
    """About ``per_class`` rows of each class (sizes in ``classes``), chosen by a hash of the id, so reruns agree."""
    rates = [(k, min(1.0, per_class / n)) for k, n in classes.items() if n]
    keep = reduce(lambda a, b: a | b, [(F.col("label") == k) & (spread("doc_id", seed) < p) for k, p in rates], F.lit(False))
    return df.filter(keep)


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, per_class: int, seed: int) -> DataFrame:
    """(doc_id, text, label) of the sampled training rows, as a table in the shared folder.

    The sample has at most about two times ``per_class`` ids whatever the input,
    which is the size bound that lets it be broadcast to the scan of the texts.
    """
    known = training_labels(labels, label)
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect() if r["label"] in (0, 1)}
    chosen = sampled(known, sizes, per_class, seed)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return write_table(texts, f"sample-{label}")
