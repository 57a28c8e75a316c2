"""Incremental indexing and resumable batches: change capture, upserts, latest rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions.text import uuid5_url
from corpusloom.sources import storage


def indexing_plan(manifest: DataFrame, scan: DataFrame, rebuild: bool = False) -> DataFrame:
    """(relative_path, change_type): new, unchanged (same hash), changed or deleted; a rebuild has all as new, and what was before as deleted too."""
    old = manifest.select("relative_path", F.col("sha256").alias("old"))
    new = scan.select("relative_path", F.col("sha256").alias("new"))
    if rebuild:
        return new.select("relative_path", F.lit("new").alias("change_type")).unionByName(old.select("relative_path", F.lit("deleted").alias("change_type")))
    kind = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "deleted").when(F.col("old") == F.col("new"), "unchanged").otherwise("changed")
    return old.join(new, "relative_path", "full_outer").select("relative_path", kind.alias("change_type"))


def indexing_summary(plan: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: documents of each change type, and the chunks of unchanged ones, which are used again. ``chunks`` has (relative_path, chunk_count)."""
    rows = plan.join(chunks, "relative_path", "left")
    counts = [F.count_if(F.col("change_type") == kind).alias(f"{kind}_documents") for kind in ("new", "changed", "unchanged", "deleted")]
    reused = F.sum(F.when(F.col("change_type") == "unchanged", F.coalesce("chunk_count", F.lit(0))).otherwise(0))
    return rows.agg(*counts, F.coalesce(reused, F.lit(0)).cast("long").alias("reused_chunks"))


def point_id(source: Column, page: Column, index: Column, start: Column, chunk: Column, text: Column) -> Column:
    """Stable id of a chunk; its text is part of it only where no location is known."""
    located = F.coalesce(page.cast("string"), index.cast("string"), start.cast("string"), chunk).isNotNull()
    parts = [source, page, index, start, chunk, F.when(located, F.lit("")).otherwise(text)]
    return uuid5_url(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All rows of ``new`` and those of ``old`` whose key it lacks; of repeated keys in ``new`` one row stays."""
    return old.join(new.select(key), key, "left_anti").unionByName(new.dropDuplicates([key]))


def delete_documents(points: DataFrame, doomed: DataFrame) -> DataFrame:
    """Points without those whose document_id or relative_path is listed in ``doomed``."""
    by_id = points.join(doomed.select("document_id").filter("document_id is not null"), "document_id", "left_anti")
    return by_id.join(doomed.select("relative_path").filter("relative_path is not null"), "relative_path", "left_anti").select(*points.columns)


def checked_dimension(points: DataFrame, column: str, dimension: int) -> DataFrame:
    """The points, with an error at run time for a vector of another size."""
    bad = F.size(column) != dimension
    return points.withColumn(column, F.when(bad, F.raise_error(F.lit(f"vectors must have {dimension} dimensions"))).otherwise(F.col(column)))


def latest_per_key(rows: DataFrame, key: str, ordinal: str) -> DataFrame:
    """The row with the largest ordinal of each key, combined on the map side."""
    other = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*other), ordinal).alias("_row")).select(key, "_row.*").select(*rows.columns)


def question_key(index: Column, question: Column) -> Column:
    return F.concat(index.cast("string"), F.lit(":"), F.sha2(F.trim(F.regexp_replace(question, r"(?U)\s+", " ")), 256))


def pending(questions: DataFrame, done: DataFrame, key: str = "key") -> DataFrame:
    return questions.join(done.select(key), key, "left_anti")


def completed(done: DataFrame, rows: DataFrame, key: str = "key", ordinal: str = "ordinal") -> DataFrame:
    """The latest row of each completed key, with an error at run time for a key without one."""
    found = done.select(key).distinct().join(latest_per_key(rows, key, ordinal).withColumn("_found", F.lit(True)), key, "left")
    checked = F.when(F.col("_found").isNull(), F.raise_error(F.concat(F.lit("no row for completed key "), F.col(key)))).otherwise(F.col(key))
    return found.withColumn(key, checked).drop("_found")


def fingerprint(corpus: DataFrame, order: list[str]) -> DataFrame:
    """One row (rows, fingerprint) that changes with any chunk, without gathering the corpus in one place.

    Each row's hash is folded by position-free sums, so partitions combine; order counts through the hashed order columns.
    """
    h = F.sha2(F.concat_ws("\x00", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in [*order, "text"]]), 256)
    parts = [F.sum(F.conv(F.substring(h, i, 12), 16, 10).cast("decimal(38,0)")).cast("string") for i in (1, 13, 25, 37)]
    return corpus.agg(F.count("*").alias("rows"), F.sha2(F.concat_ws(":", F.count("*").cast("string"), *parts), 256).alias("fingerprint"))


FANOUT, LEVELS = 1024, 4


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``number``, 0, 1, 2, ... in ``order``, nulls last: a range sort, a row's place in its range, and the sizes of the ranges before, one row each.

    Rows that are equal in ``order`` are numbered in any way, so name enough columns.
    """
    columns = [F.col(c).asc_nulls_last() for c in order]
    ranged = rows.repartitionByRange(*columns).sortWithinPartitions(*columns)
    # in one pass over the sorted ranges: the range, and the place in it
    placed = ranged.withColumn("_at", F.monotonically_increasing_id()).withColumn("_range", F.shiftright("_at", 33))
    placed = storage.written(placed, "places")  # ranges are sampled: both readers below must see the same ones
    sizes = placed.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(W.orderBy("_range")) - F.col("_n")).alias("_before"))
    out = placed.join(F.broadcast(before), "_range")  # a row for each range
    return out.withColumn("number", F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_range", "_before")


def tree_fingerprint(corpus: DataFrame, order: list[str], columns: list[str], fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """One row (rows, fingerprint) that changes with any cell and with the order of rows, however they are partitioned.

    Rows are numbered in ``order``, which settles all ties but of equal rows; a leaf is the digest of a row's ``columns``, and on each level the digests of ``fanout``
    consecutive nodes, joined in order, give the one of the node above. Order counts by place, so what is digested needn't hold it.
    A node's children meet by number, so no task holds more than ``fanout`` digests of a node. Holds for up to fanout ** levels rows.
    """
    leaf = F.sha2(F.concat(*[F.concat(F.coalesce(F.col(c).cast("string"), F.lit("\x01")), F.lit("\x00")) for c in columns]), 256)
    nodes = numbered(corpus.select(*order, leaf.alias("digest")), [*order, "digest"]).select("number", "digest")
    rows = nodes.agg(F.count("*").alias("rows"))
    for _ in range(levels):
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", "digest"))), lambda x: x["digest"]), "")
        nodes = nodes.groupBy(F.floor(F.col("number") / fanout).alias("_up")).agg(F.sha2(joined, 256).alias("digest")).select(F.col("_up").alias("number"), "digest")
    return rows.crossJoin(F.broadcast(nodes.agg(F.max("digest").alias("top")))).select("rows", F.sha2(F.concat_ws(":", F.col("rows").cast("string"), F.coalesce("top", F.lit(""))), 256).alias("fingerprint"))
