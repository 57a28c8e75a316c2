"""Nearest neighbours by inner product over balanced posting lists.

Centroids are fitted on a bounded sample (``SAMPLE`` vectors at most) and split
where they hold too many. Every vector goes to the list of its nearest centroid and,
near a boundary, to further lists whose centroids are almost as close and not
closer to one already chosen. A query walks a graph of the centroids held in
memory, and reads the lists whose distance is within a ratio of the nearest one's, and further ones as
long as those read hold fewer vectors than it asks for.
Lists are cut into blocks, so a list that holds a third of all vectors is still
read by many tasks. Largest inner product becomes smallest distance by one more
coordinate, sqrt(max norm ^ 2 - norm ^ 2), which is 0 for queries. The index looks at vectors
scaled by the largest component of all; scores are inner products of the original ones in double precision.

Defined cases: vectors that are null, zero, of another dimension than most, or
hold null or non-finite components take no part, neither do rows without id;
of rows with the same id the one that sorts last counts; with fewer candidates than ``k``
all are returned; a score that overflows is infinite, one that isn't a number counts as the smallest; ties go to
the smaller id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import spread, write_table

LIST, CENTROIDS, SAMPLE = 250, 4096, 30_000
REPLICAS, BOUNDARY = 4, 1.10
NEIGHBOURS, BEAM = 16, 96
RATIO, LEAST_LISTS, BLOCK, QUERIES = 1.25, 16, 1024, 128


def valid_vectors(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """(id, vector): one row per id, only vectors that take part."""
    # floats stay floats, which is exact and half as large; anything else is searched as doubles
    kind = "float" if vectors.schema[column].dataType == T.ArrayType(T.FloatType(), vectors.schema[column].dataType.containsNull) else "double"
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(column).cast(f"array<{kind}>").alias("vector")).filter(
        "id is not null and vector is not null and size(vector) > 0 and forall(vector, x -> x is not null and abs(x) < double('inf')) and exists(vector, x -> x != 0)"
    )
    sizes = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.filter(F.size("vector") == (sizes[0]["n"] if sizes else 0)).groupBy("id").agg(F.max("vector").alias("vector"))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T), 0)


def balanced_centroids(sample: np.ndarray, k: int, seed: int = 1, rounds: int = 10) -> np.ndarray:
    """k-means whose clusters of more than twice the average are split; nearly empty ones go."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), min(k, len(sample)), replace=False)]
    for step in range(rounds):
        near = np.concatenate([_distances(sample[i : i + 4096], centres).argmin(1) for i in range(0, len(sample), 4096)])
        size = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        centres = sums[size > 0] / size[size > 0, None]
        if step in (rounds // 3, 2 * rounds // 3):
            size = size[size > 0]
            large = np.flatnonzero(size > 2 * size.mean())
            shift = rng.standard_normal(centres[large].shape) * 1e-2
            centres = np.concatenate([np.delete(centres, large, 0), centres[large] + shift, centres[large] - shift])
    return centres.astype(np.float32)


class CentroidGraph:
    """Each centroid linked to its nearest ones; best-first search from a few spread starts."""

    def __init__(self, centres: np.ndarray):
        self.centres = centres.astype(np.float64)
        d = _distances(self.centres, self.centres)
        m = min(NEIGHBOURS, len(centres) - 1)
        links: list[set[int]] = [set(map(int, np.argsort(r, kind="stable")[: m + 1])) - {i} for i, r in enumerate(d)]
        for i in range(len(links)):
            for j in list(links[i]):
                links[j].add(i)
        self.links = [np.array(sorted(x), int) for x in links]
        self.starts = list(range(0, len(centres), max(1, len(centres) // 16)))

    def search(self, query: np.ndarray, beam: int = BEAM) -> list[tuple[float, int]]:
        """(squared distance, centroid) of about the ``beam`` nearest, nearest first."""
        seen = np.zeros(len(self.centres), bool)
        seen[self.starts] = True
        first = ((self.centres[self.starts] - query) ** 2).sum(1)
        open_ = [(float(d), c) for d, c in zip(first, self.starts, strict=True)]
        heapq.heapify(open_)
        best = [(-d, c) for d, c in open_]
        heapq.heapify(best)
        while open_:
            d, c = heapq.heappop(open_)
            if len(best) >= beam and d > -best[0][0]:
                break
            new = self.links[c][~seen[self.links[c]]]
            seen[new] = True
            for e, j in zip(((self.centres[new] - query) ** 2).sum(1), new, strict=True):
                if len(best) < beam or e < -best[0][0]:
                    heapq.heappush(open_, (float(e), int(j)))
                    heapq.heappush(best, (-float(e), int(j)))
                    if len(best) > beam:
                        heapq.heappop(best)
        return sorted((-d, c) for d, c in best)

    def lists(self, query: np.ndarray, held: np.ndarray, wanted: int, ratio: float = RATIO, least: int = LEAST_LISTS) -> list[int]:
        """Lists to read: the ``least`` nearest, all within ``ratio`` times the nearest distance, and more until they hold ``wanted`` vectors.

        ``held`` counts the vectors whose first list each is, so what lists hold together are different vectors.
        """
        found = self.search(query)
        limit = found[0][0] * ratio * ratio
        near = [c for i, (d, c) in enumerate(found) if i < least or d <= limit]
        if held[near].sum() >= wanted:
            return near
        d = ((self.centres - query) ** 2).sum(1)
        order = np.argsort(d, kind="stable")
        more = order[: int(np.searchsorted(np.cumsum(held[order]), wanted)) + 1]
        return [*near, *sorted(set(more.tolist()) - set(near))]


def _stack(column: pa.Array, scale: float = 1.0) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64) / scale


def _lifted(x: np.ndarray, top: float) -> np.ndarray:
    return np.c_[x, np.sqrt(np.maximum(top - (x * x).sum(1), 0))]


def search(vectors: DataFrame, key: str, column: str, every: int, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): for every id divisible by ``every`` the ``k`` nearest other vectors found."""
    spark = vectors.sparkSession
    rows = write_table(valid_vectors(vectors, key, column), "vectors")
    n, scale = rows.agg(F.count("*"), F.max(F.array_max(F.transform("vector", lambda x: F.abs(x.cast("double")))))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    squares = F.aggregate("vector", F.lit(0.0), lambda a, x: a + (x.cast("double") / scale) * (x.cast("double") / scale))
    top = rows.agg(F.max(squares)).first()[0]
    fit = rows.filter(spread("id", 5) < min(1.0, SAMPLE / n)).orderBy("id").limit(SAMPLE + SAMPLE // 10).select("vector").toArrow()
    fit = fit if fit.num_rows else rows.orderBy("id").limit(1).select("vector").toArrow()
    centres = balanced_centroids(_lifted(_stack(fit.column(0), scale), top), max(1, min(CENTROIDS, round(n / LIST))))
    shared = spark.sparkContext.broadcast(centres)  # CENTROIDS rows and a few at most

    def assign(batches):
        centres = shared.value.astype(np.float64)
        between = _distances(centres, centres)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                piece = batch.slice(at, 2048)
                d = _distances(_lifted(_stack(piece.column(1), scale), top), centres)
                m = min(REPLICAS * 2, d.shape[1])
                near = np.argpartition(d, m - 1, axis=1)[:, :m]
                near = np.take_along_axis(near, np.take_along_axis(d, near, 1).argsort(1, kind="stable"), 1)
                row, lists, first = [], [], []
                for i, some in enumerate(near):
                    chosen = [some[0]]
                    for c in some[1:]:
                        if len(chosen) == REPLICAS or d[i, c] > BOUNDARY**2 * d[i, some[0]]:
                            break
                        if all(between[c, o] > d[i, c] for o in chosen):
                            chosen.append(c)
                    row += [i] * len(chosen)
                    lists += chosen
                    first += [True] + [False] * (len(chosen) - 1)
                taken = piece.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int32()), *taken.columns, pa.array(first)], ["list", "id", "vector", "first"])

    schema = f"list int, id long, vector {rows.schema['vector'].dataType.simpleString()}"
    postings = write_table(rows.mapInArrow(assign, f"{schema}, first boolean"), "postings")
    held = np.zeros(len(centres), np.int64)
    for r in postings.filter("first").groupBy("list").count().collect():  # a row for each centroid
        held[r["list"]] = r["count"]

    def route(batches):
        graph = CentroidGraph(shared.value)
        for batch in batches:
            x = np.c_[_stack(batch.column(1), scale), np.zeros(batch.num_rows)] if batch.num_rows else []
            lists = [graph.lists(q, held, k + 1) for q in x]
            taken = batch.take(pa.array([i for i, some in enumerate(lists) for _ in some], pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([c for some in lists for c in some], pa.int32()), *taken.columns], ["list", "id", "vector"])

    asked = write_table(rows.filter(F.col("id") % every == 0).mapInArrow(route, schema), "queries")

    def blocks(df: DataFrame, size: int, prefix: str) -> DataFrame:
        """(list, ids, vectors): rows of a list in blocks of about ``size``."""
        count = df.groupBy("list").count()  # a row for each centroid
        dealt = df.join(F.broadcast(count), "list").withColumn("block", F.pmod(F.xxhash64("id"), F.ceil(F.col("count") / size)))
        held = dealt.groupBy("list", "block").agg(F.sort_array(F.collect_list(F.struct("id", "vector"))).alias("held"))
        return held.select("list", F.col("held.id").alias(f"{prefix}_ids"), F.flatten("held.vector").alias(f"{prefix}_vectors"))

    pairs = blocks(postings, BLOCK, "v").join(blocks(asked, QUERIES, "q"), "list").select("q_ids", "q_vectors", "v_ids", "v_vectors")

    def nearest(batches):
        for batch in batches:
            for q_ids, q, v_ids, v in zip(*batch.columns, strict=True):
                q_ids, v_ids = q_ids.values.to_numpy(), v_ids.values.to_numpy()
                q = q.values.to_numpy().astype(np.float64).reshape(len(q_ids), -1)
                v = v.values.to_numpy().astype(np.float64).reshape(len(v_ids), -1)
                out = []
                for one, x in zip(q_ids, q, strict=True):
                    with np.errstate(over="ignore", invalid="ignore"):
                        score = np.nan_to_num((v * x).sum(1), nan=-np.inf, posinf=np.inf, neginf=-np.inf)  # row by row alike, so equal vectors get equal scores
                    other = np.flatnonzero(v_ids != one)
                    some = other[np.lexsort((v_ids[other], -score[other]))[:k]]
                    out.append((np.full(len(some), one), v_ids[some], score[some]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["query_id", "vec_id", "score"])

    found = pairs.mapInArrow(nearest, "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    place = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
