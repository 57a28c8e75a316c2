"""A lexical index that follows its corpus: segments of postings, tombstones and versions.

A store is a folder. ``apply`` compares a scan of the corpus with the documents of the newest version,
tokenises what is new or changed into one more segment, and writes the table of live documents and the document counts of terms
anew: a term's count grows by the new segment's and shrinks by that of the documents that went. A document is live in one segment only, so
rows of changed and deleted ones die with the new table of documents; ``compact`` rewrites the living rows as one segment.

Each step writes to folders of its own. A version counts when its row is in the log, which is written last and after
the counts of what was written agree with what was meant; a writer that dies before leaves the last version untouched.
Readers check that the parts of their version are there and whole, and raise ``Inconsistent`` otherwise.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import word_tokens
from corpusloom.operators import incremental, lexical
from corpusloom.sources.storage import publish, published, written

_LOG = "version long, segments array<struct<folder:string,rows:bigint>>, documents string, live long, terms string, vocabulary long, new_documents long, changed_documents long, deleted_documents long, unchanged_documents long"


class Inconsistent(RuntimeError):
    """A part of the store is missing, empty or shorter than its version says; ``apply`` with ``rebuild`` mends it."""


def current(spark: SparkSession, path: str) -> Row | None:
    """The newest version; of two writers that made the same one, the first by name, so all readers agree."""
    return max(published(spark, f"{path}/log", _LOG), key=lambda r: (r.version, [-ord(c) for c in r.documents]), default=None)


def _part(spark: SparkSession, folder: str, rows: int) -> DataFrame:
    try:
        found = spark.read.parquet(folder)
        held = found.count()  # from the files' footers
    except AnalysisException as e:
        raise Inconsistent(f"{folder} is missing") from e
    if held < rows:
        raise Inconsistent(f"{folder} {'is empty' if not held else f'holds {held} rows'}, its version has {rows}")
    return found


def _segments(spark: SparkSession, at: Row) -> DataFrame | None:
    parts = [_part(spark, s.folder, s.rows).withColumn("segment", F.lit(s.folder)) for s in at.segments]
    return reduce(DataFrame.unionByName, parts) if parts else None


def _documents(spark: SparkSession, at: Row) -> DataFrame:
    return _part(spark, at.documents, at.live)


_POSTINGS = "relative_path string, term string, tf long, length long"
_DOCUMENTS = "relative_path string, sha256 string, segment string, length long, distinct_terms long"


def _written(df: DataFrame, folder: str, rows: int | None = None) -> int:
    """Writes and counts; with ``rows``, an error where another number arrived."""
    df.write.parquet(folder)
    n = df.sparkSession.read.schema(df.schema).parquet(folder).count()
    if rows is not None and n != rows:
        raise Inconsistent(f"{folder} holds {n} rows instead of {rows}")
    return n


def apply(path: str, scan: DataFrame, rebuild: bool = False, tokens: Column | None = None) -> Row:
    """Brings the store to ``scan`` (relative_path, sha256, text) and returns the new version's row.

    Paths are unique. A null or empty text is a document without terms; null ones don't count in the average length. Only new and changed documents are
    tokenised. With ``rebuild`` all are, and nothing older is read.
    """
    spark, at = scan.sparkSession, None if rebuild else current(scan.sparkSession, path)
    old = _documents(spark, at) if at else spark.createDataFrame([], _DOCUMENTS)
    return _applied(path, at, old, incremental.indexing_plan(old.select("relative_path", "sha256"), scan.select("relative_path", "sha256")), scan, tokens)


def change(path: str, rows: DataFrame, tokens: Column | None = None) -> Row:
    """Brings some documents of the store to ``rows`` (relative_path, sha256, text, deleted); all others stay as they are.

    A path that is deleted though the store lacks it changes nothing. Doing the same change again makes a version with the same content, so a change may be repeated.
    """
    spark, at = rows.sparkSession, current(rows.sparkSession, path)
    old = _documents(spark, at) if at else spark.createDataFrame([], _DOCUMENTS)
    rows = written(rows.withColumn("deleted", F.coalesce("deleted", F.lit(False))), "changes")
    touched = old.join(rows.select("relative_path"), "relative_path", "left_semi").select("relative_path", "sha256")
    plan = incremental.indexing_plan(touched, rows.filter("not deleted").select("relative_path", "sha256"))
    others = old.join(rows.select("relative_path"), "relative_path", "left_anti").select("relative_path", F.lit("unchanged").alias("change_type"))
    return _applied(path, at, old, plan.unionByName(others), rows.filter("not deleted").select("relative_path", "sha256", "text"), tokens)


def follow(stream: DataFrame, path: str, checkpoint: str):
    """A writer that applies each micro-batch of a stream of changes (seq, relative_path, text, deleted) to the store: of a path's changes in a micro-batch the last by seq counts.

    A micro-batch that is repeated after a crash finds its documents unchanged, or applies them as it would have.
    """

    def each(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        last = batch.groupBy("relative_path").agg(F.max_by(F.struct("text", "deleted"), "seq").alias("x")).select("relative_path", "x.*")
        change(path, last.withColumn("sha256", F.sha2(F.coalesce("text", F.lit("")), 256)))

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)


def _applied(path: str, at: Row | None, old: DataFrame, plan: DataFrame, scan: DataFrame, tokens: Column | None) -> Row:
    spark, step = scan.sparkSession, uuid.uuid4().hex
    plan_folder = f"{path}/plans/{step}"
    _written(plan, plan_folder)
    plan = spark.read.parquet(plan_folder)
    counts = {r["change_type"]: r["count"] for r in plan.groupBy("change_type").count().collect()}
    changed = plan.filter("change_type in ('new', 'changed')").select("relative_path")

    t = tokens if tokens is not None else word_tokens(F.col("text"))
    fresh = scan.join(changed, "relative_path", "left_semi")
    segment = f"{path}/segments/{step}"
    rows = _written(lexical.postings(fresh.select("relative_path", "text"), "relative_path", t).select("relative_path", "term", "tf", "length"), segment)
    held = spark.read.schema(_POSTINGS).parquet(segment)
    sizes = held.groupBy("relative_path").agg(F.max("length").alias("length"), F.count("*").alias("distinct_terms"))
    entries = fresh.select("relative_path", "sha256", F.when(F.col("text").isNotNull(), 0).alias("none")).join(sizes, "relative_path", "left")
    entries = entries.select("relative_path", "sha256", F.lit(segment).alias("segment"), F.coalesce("length", "none").cast("long").alias("length"), F.coalesce("distinct_terms", F.lit(0)).cast("long").alias("distinct_terms"))
    stays = old.join(plan.filter("change_type = 'unchanged'"), "relative_path", "left_semi")
    documents = f"{path}/documents/{step}"
    live = _written(stays.select(*entries.columns).unionByName(entries), documents, sum(n for kind, n in counts.items() if kind != "deleted"))

    # document counts of terms: what came, less what went
    deltas = held.groupBy("term").agg(F.count("*").alias("df"))
    segments = [*at.segments] if at else []
    if at:
        went = plan.filter("change_type in ('changed', 'deleted')").select("relative_path")
        dead = _segments(spark, at).join(old.join(went, "relative_path", "left_semi").select("relative_path", "segment"), ["relative_path", "segment"], "left_semi") if segments else held.limit(0)
        before = _part(spark, at.terms, at.vocabulary).select("term", "df")
        deltas = before.unionByName(deltas).unionByName(dead.groupBy("term").agg((-F.count("*")).alias("df")))
    terms = f"{path}/terms/{step}"
    vocabulary = _written(deltas.groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0"), terms)
    if rows:
        segments.append(Row(folder=segment, rows=rows))
    return _publish(spark, path, at, segments, documents, live, terms, vocabulary, counts)


def _publish(spark: SparkSession, path: str, at: Row | None, segments: list, documents: str, live: int, terms: str, vocabulary: int, counts: dict[str, int]) -> Row:
    newest = current(spark, path)
    entry = dict(version=(newest.version if newest else 0) + 1, segments=segments, documents=documents, live=live, terms=terms, vocabulary=vocabulary, **{f"{k}_documents": counts.get(k, 0) for k in ("new", "changed", "deleted", "unchanged")})
    if at is not None and newest is not None and newest.version != at.version:
        raise Inconsistent(f"version {newest.version} was published meanwhile; apply again")
    publish(spark, f"{path}/log", entry, _LOG)
    won = current(spark, path)
    if won.documents != documents:
        raise Inconsistent(f"another writer published version {won.version}; apply again")
    return won


def read(spark: SparkSession, path: str) -> lexical.Index:
    """The index of the newest version, checked: postings (relative_path, term, tf, length), terms and statistics."""
    at = current(spark, path)
    if at is None:
        raise Inconsistent(f"{path} has no version")
    documents = _documents(spark, at)
    rows = _segments(spark, at)
    if rows is None:
        rows = spark.createDataFrame([], f"{_POSTINGS}, segment string")
    postings = rows.join(documents.select("relative_path", "segment"), ["relative_path", "segment"], "left_semi").select("relative_path", "term", "tf", "length")
    stats = documents.agg(F.count("*").alias("n"), F.avg("length").alias("avgdl"))
    return lexical.Index(postings, lexical.idfs(_part(spark, at.terms, at.vocabulary), stats), stats)


def check(spark: SparkSession, path: str) -> Row:
    """The newest version's row, once its documents' own counts agree with the living postings."""
    at = current(spark, path)
    if at is None:
        raise Inconsistent(f"{path} has no version")
    meant = _documents(spark, at).agg(F.coalesce(F.sum("distinct_terms"), F.lit(0))).first()[0]
    held = read(spark, path).postings.count()
    if held != meant:
        raise Inconsistent(f"{path} holds {held} postings, its documents have {meant}")
    return at


def compact(spark: SparkSession, path: str) -> Row:
    """Rewrites the living postings as one segment, as a new version; older folders stay until ``vacuum``."""
    at = check(spark, path)
    step = uuid.uuid4().hex
    segment, documents = f"{path}/segments/{step}", f"{path}/documents/{step}"
    rows = _written(read(spark, path).postings, segment)
    live = _written(_documents(spark, at).withColumn("segment", F.lit(segment)), documents, at.live)
    return _publish(spark, path, at, [Row(folder=segment, rows=rows)] if rows else [], documents, live, at.terms, at.vocabulary, {"unchanged": live})
