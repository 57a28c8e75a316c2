"""Exact vector retrieval."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Queries are handed to the scan in groups of this many, so what a group broadcasts has a fixed size.
QUERY_GROUP = 4096


def dense_topk(queries: DataFrame, points: DataFrame, k: int) -> DataFrame:
    """(query_id, point_id, score, rank): ``k`` points of the largest cosine for each query; ties to the smaller id.

    ``queries`` has (query_id, vector), ``points`` (point_id, vector). A batch of questions is
    small beside the points: it reaches the scan as one matrix for each group of
    ``QUERY_GROUP``, each batch of points keeps its ``k`` best for each query, and only those are shuffled.
    """
    spark = points.sparkSession
    n = queries.count()
    rows = queries.select(F.col("query_id").cast("long"), F.col("vector").cast("array<double>"))
    found: DataFrame | None = None
    for group in range(-(-n // QUERY_GROUP) or 1):
        part = rows.filter(F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-n // QUERY_GROUP)))) == group).toArrow()
        ids = part.column(0).to_numpy()
        matrix = np.array(part.column(1).to_pylist(), float).reshape(len(ids), -1)
        shared = spark.sparkContext.broadcast((ids, matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)))

        def best(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            for batch in batches:
                if not batch.num_rows or not len(ids):
                    continue
                points = batch.column(0).to_numpy()
                v = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(points), -1).astype(float)
                score = np.round(v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300) @ q.T, 6)
                for i in range(len(ids)):
                    some = np.lexsort((points, -score[:, i]))[:k]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), ids[i])), pa.array(points[some]), pa.array(score[some, i])], ["query_id", "point_id", "score"])

        near = points.select(F.col("point_id").cast("long"), "vector").mapInArrow(best, "query_id long, point_id long, score double")
        found = near if found is None else found.unionByName(near)
    place = W.partitionBy("query_id").orderBy(F.desc("score"), "point_id")
    return found.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)
