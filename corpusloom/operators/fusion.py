"""Rankings fused, merged and deduplicated."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def rrf_fuse(rankings: DataFrame, key: str = "chunk_id", k: int = 60, top_k: int | None = None) -> DataFrame:
    """(query_id, key, rrf_score, sources, ranks, fused_rank) by reciprocal rank fusion.

    ``rankings`` has (query_id, retriever, retriever_order, rank, key) and may have ``weight``. An item that a
    ranking repeats counts once, at its best rank; the other ranks stay as they
    are. Ties go to the item seen first, by retriever and rank.
    """
    weight = F.col("weight") if "weight" in rankings.columns else F.lit(1.0)
    best = rankings.withColumn("weight", weight).groupBy("query_id", key, "retriever", "retriever_order").agg(F.min("rank").alias("rank"), F.first("weight").alias("weight"))
    fused = best.groupBy("query_id", key).agg(
        F.round(F.sum(F.col("weight") / (k + F.col("rank"))), 9).alias("rrf_score"),
        F.min(F.struct("retriever_order", "rank")).alias("seen"),
        F.array_sort(F.collect_list(F.struct("retriever_order", "retriever", "rank"))).alias("by"),
    )
    place = W.partitionBy("query_id").orderBy(F.desc("rrf_score"), "seen", key)
    out = fused.withColumn("fused_rank", F.row_number().over(place)).select(
        "query_id", key, "rrf_score", F.col("by.retriever").alias("sources"), F.map_from_arrays("by.retriever", "by.rank").alias("ranks"), "fused_rank"
    )
    return out.filter(F.col("fused_rank") <= top_k) if top_k else out


def hybrid(rankings: dict[str, DataFrame], top_k: int, key: str = "chunk_id", k: int = 60, weights: dict[str, float] | None = None) -> DataFrame:
    """Rankings (query_id, key, rank) of several retrievers over one corpus, fused and cut to ``top_k``: as ``rrf_fuse``, so each
    row keeps the retrievers that found it and its rank in each. Ties go to the retriever named first."""
    parts = [
        df.select("query_id", key, F.lit(name).alias("retriever"), F.lit(i).alias("retriever_order"), "rank", F.lit(float((weights or {}).get(name, 1.0))).alias("weight"))
        for i, (name, df) in enumerate(rankings.items())
    ]
    return rrf_fuse(reduce(DataFrame.unionByName, parts), key, k, top_k)


def retrieve(mode: str, retrievers: dict[str, Callable[[], DataFrame]], top_k: int, key: str = "chunk_id") -> DataFrame:
    """(query_id, key, rank) by the retriever of that name, or by all of them fused where the mode is ``hybrid``."""
    if mode == "hybrid":
        return hybrid({n: f() for n, f in retrievers.items()}, top_k, key).select("query_id", key, F.col("fused_rank").alias("rank"))
    if mode not in retrievers:
        raise ValueError(f"unknown mode {mode!r}: choose one of {', '.join([*retrievers, 'hybrid'])}")
    return retrievers[mode]().filter(F.col("rank") <= top_k).select("query_id", key, "rank")


def deduplicate(results: DataFrame, key: str = "chunk_id") -> DataFrame:
    """One row per (query_id, key): the highest score, the first on ties, with all techniques that found it in the order seen.

    ``results`` has (query_id, key, score, technique, pos). A null key never merges. Ordered by score, nulls
    last, then by the first position: that is ``place``.
    """
    same = F.coalesce(F.col(key), F.concat(F.lit("\x00"), F.col("pos")))
    rows = results.withColumn("_same", same).groupBy("query_id", "_same").agg(
        F.first(key).alias(key),
        F.max("score").alias("score"),
        F.min("pos").alias("first_pos"),
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("pos", "technique"))), lambda x: x["technique"])).alias("matched_queries"),
    )
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc_nulls_last("score"), "first_pos"))
    return rows.withColumn("place", place).drop("_same")


def overlap_counts(a: DataFrame, b: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(query_id, only_a, only_b, both, either) of two rankings."""
    sides = a.select("query_id", key, F.lit(1).alias("s")).unionByName(b.select("query_id", key, F.lit(2).alias("s")))
    per = sides.groupBy("query_id", key).agg(F.min("s").alias("low"), F.max("s").alias("high"))
    return per.groupBy("query_id").agg(
        F.count_if(F.col("high") == 1).alias("only_a"), F.count_if(F.col("low") == 2).alias("only_b"), F.count_if(F.col("low") < F.col("high")).alias("both"), F.count("*").alias("either")
    )
