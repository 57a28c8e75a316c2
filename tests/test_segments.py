import os
import shutil

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import lexical
from corpusloom.sources import segments, storage


def scan(spark, texts):
    return spark.createDataFrame([(p, t) for p, t in texts.items()], "relative_path string, text string").withColumn("sha256", F.sha2(F.coalesce("text", F.lit("")), 256))


def rows(df):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())


FIRST = {"a": "one two two three", "b": "two four", "c": "", "d": "five one", "e": None, "f": "six"}
SECOND = {"a": "one two two three", "b": "two seven seven", "c": "now some words", "e": None, "g": "one eight"}


def same_as_rebuilt(spark, path, texts):
    got, want = segments.read(spark, path), lexical.index(scan(spark, texts), "relative_path")
    assert rows(got.postings) == rows(want.postings) and rows(got.terms) == rows(want.terms) and rows(got.stats) == rows(want.stats)


def test_changes_give_what_a_rebuild_gives(spark, tmp_path):
    path = str(tmp_path / "index")
    assert segments.apply(path, scan(spark, FIRST)).new_documents == 6
    same_as_rebuilt(spark, path, FIRST)
    at = segments.apply(path, scan(spark, SECOND))
    assert (at.version, at.new_documents, at.changed_documents, at.deleted_documents, at.unchanged_documents) == (2, 1, 2, 2, 2)
    same_as_rebuilt(spark, path, SECOND)
    # only new and changed documents were tokenised
    assert {r.relative_path for r in spark.read.parquet(at.segments[-1].folder).collect()} == {"b", "c", "g"}
    again = segments.apply(path, scan(spark, SECOND))
    assert len(again.segments) == len(at.segments) and again.unchanged_documents == 5
    back = segments.apply(path, scan(spark, FIRST))
    same_as_rebuilt(spark, path, FIRST)
    assert len(segments.compact(spark, path).segments) == 1 < len(back.segments)
    same_as_rebuilt(spark, path, FIRST)
    segments.apply(path, scan(spark, SECOND))
    same_as_rebuilt(spark, path, SECOND)
    segments.apply(path, scan(spark, {}))
    assert rows(segments.read(spark, path).postings) == [] and segments.check(spark, path).live == 0


def test_a_writer_that_dies_leaves_the_last_version(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "index")
    segments.apply(path, scan(spark, FIRST))

    def dies(*a, **k):
        raise KeyboardInterrupt

    for where in ("_publish", "publish"):
        with monkeypatch.context() as m:
            m.setattr(segments, where, dies)
            with pytest.raises(KeyboardInterrupt):
                segments.apply(path, scan(spark, SECOND))
        assert segments.check(spark, path).version == 1
        same_as_rebuilt(spark, path, FIRST)
    assert segments.apply(path, scan(spark, SECOND)).version == 2
    same_as_rebuilt(spark, path, SECOND)


def test_two_writers(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "index")
    segments.apply(path, scan(spark, FIRST))
    publish, late = segments._publish, []

    def meanwhile(*a):
        if not late:
            late.append(True)
            segments.apply(path, scan(spark, {"z": "other"}))
        return publish(*a)

    monkeypatch.setattr(segments, "_publish", meanwhile)
    with pytest.raises(segments.Inconsistent, match="meanwhile"):
        segments.apply(path, scan(spark, SECOND))
    same_as_rebuilt(spark, path, {"z": "other"})


def test_a_stream_of_changes(spark, tmp_path):
    """Micro-batches of new, changed and deleted documents give what a scan of the end gives."""
    path, source = str(tmp_path / "index"), str(tmp_path / "in")
    schema = "seq long, relative_path string, text string, deleted boolean"
    steps = [
        [(1, "a", "one two", False), (2, "b", "two", False), (3, "a", "one three", None)],
        [(4, "b", None, True), (5, "c", "four four", False), (6, "missing", None, True)],
        [(7, "c", "four four", False), (8, "d", "", False), (9, "b", "two again", False)],
    ]
    for rows in steps:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    for _ in range(2):  # the second finds nothing more
        query = segments.follow(stream, path, str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination()
    at = segments.check(spark, path)
    assert at.version == 3 and at.live == 4
    same_as_rebuilt(spark, path, {"a": "one three", "b": "two again", "c": "four four", "d": ""})
    # a micro-batch that is applied twice
    again = segments.change(path, spark.createDataFrame(steps[2], schema).withColumn("sha256", F.sha2("text", 256)).drop("seq"))
    assert again.version == 4 and again.unchanged_documents == 4 and len(again.segments) == len(at.segments)
    same_as_rebuilt(spark, path, {"a": "one three", "b": "two again", "c": "four four", "d": ""})


@pytest.mark.parametrize("part", ["segments", "documents", "terms"])
def test_missing_empty_and_short_parts_raise(spark, tmp_path, part):
    path = str(tmp_path / "index")
    with pytest.raises(segments.Inconsistent, match="no version"):
        segments.read(spark, path)
    at = segments.apply(path, scan(spark, FIRST))
    folder = at.segments[0].folder if part == "segments" else at[part]
    whole = spark.read.parquet(folder).collect()
    schema = spark.read.parquet(folder).schema
    for kept, said in ((whole[:-1], "holds"), ([], "empty"), (None, "missing")):
        shutil.rmtree(folder)
        if kept is not None:
            spark.createDataFrame(kept, schema).coalesce(1).write.parquet(folder)
        spark.catalog.refreshByPath(folder)
        with pytest.raises(segments.Inconsistent, match=said):
            segments.check(spark, path)
        with pytest.raises(segments.Inconsistent, match=said):
            segments.apply(path, scan(spark, SECOND))
    segments.apply(path, scan(spark, SECOND), rebuild=True)
    same_as_rebuilt(spark, path, SECOND)


def test_stored_tables(spark, tmp_path, monkeypatch):
    """A changed parameter changes the table; two writers of one version agree; old tables go when asked."""
    monkeypatch.setattr(storage, "shared_folder", lambda spark: str(tmp_path))
    made = []

    def build(n):
        def make():
            made.append(n)
            return spark.range(n)

        return make

    assert storage.stored(spark, "t", "v1", build(3), ("k", 1)).count() == 3
    assert storage.stored(spark, "t", "v1", build(4), ("k", 1)).count() == 3 and made == [3]
    assert storage.stored(spark, "t", "v1", build(5), ("k", 2)).count() == 5

    def race():
        storage.stored(spark, "t", "v2", build(6))
        return spark.range(7)

    assert storage.stored(spark, "t", "v2", race).count() == 6 == storage.stored(spark, "t", "v2", build(8)).count()

    def dies():
        raise RuntimeError("died")

    with pytest.raises(RuntimeError, match="died"):
        storage.stored(spark, "t", "v3", dies)
    assert storage.stored(spark, "t", "v3", build(9)).count() == 9
    assert storage.prune(spark, "t") == 4 and storage.stored(spark, "t", "v3", build(10)).count() == 9
    assert len([f for f in os.listdir(tmp_path / "corpusloom/stored/t") if f != "log"]) == 1
