"""Sinks: versions, columns, appended lines, copies, manifests made from manifests."""

import json

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import incremental, tables
from corpusloom.sources import corpus, sinks


def test_versions_never_overwrite(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'a "quoted", cell')], "n int, t string")
    paths = [sinks.write_versioned_csv(rows.withColumn("n", F.lit(i)), str(tmp_path), "out") for i in range(3)]
    assert [p.rsplit("/", 1)[1] for p in paths] == ["out", "out-v2", "out-v3"]
    read = [spark.read.option("header", True).option("escape", '"').csv(p).first() for p in paths]
    assert [(r.n, r.t) for r in read] == [(str(i), 'a "quoted", cell') for i in range(3)]


def test_results_have_fixed_columns(spark, tmp_path):
    path = str(tmp_path / "results")
    sinks.write_results(spark.createDataFrame([("x", 2)], "b string, a int"), path, ["a", "missing", "b"])
    got = spark.read.option("header", True).csv(path)
    assert got.columns == ["a", "missing", "b"] and tuple(got.first()) == ("2", None, "x")


def test_lines_and_checkpoints_are_appended(spark, tmp_path):
    lines, done = str(tmp_path / "lines"), str(tmp_path / "done")
    for i in range(2):
        sinks.append_json_lines(spark.createDataFrame([(i,)], "i int"), lines)
        sinks.write_checkpoint(spark.createDataFrame([("k", i, json.dumps({"i": i}))], "key string, ordinal long, row string"), done)
    assert sorted(r.i for r in spark.read.json(lines).collect()) == [0, 1]
    assert [json.loads(r.row) for r in incremental.latest_per_key(corpus.read_checkpoint(spark, done), "key", "ordinal").collect()] == [{"i": 1}]


def test_traces_and_reports(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps([{"q": "a"}, {"q": "b"}]))
    assert sorted(r.q for r in sinks.read_traces(spark, str(tmp_path / "t.json")).collect()) == ["a", "b"]
    (tmp_path / "r.csv").write_text("query,answer_status,latency_seconds\nwhy,answered,1.5\nhow,,x\n")
    got = sorted(tuple(r) for r in sinks.read_reports(spark, str(tmp_path / "r.csv")).select("question", F.coalesce("status", F.lit("-")), "latency").collect())
    assert got == [("how", "-", None), ("why", "answered", 1.5)]


def test_copy_keeps_ids_and_counts(spark, tmp_path):
    source, target = str(tmp_path / "a"), str(tmp_path / "b")
    spark.range(7).write.parquet(source)
    assert sinks.copy_collection(spark, source, target, dry_run=True) == (7, 0)
    assert sinks.copy_collection(spark, source, target) == (7, 7)
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        sinks.copy_collection(spark, source, target)
    assert sinks.copy_collection(spark, source, target, force=True) == (7, 7)
    assert sorted(r.id for r in spark.read.parquet(target).collect()) == list(range(7))


def test_manifest_made_from_the_last_one(spark, tmp_path):
    path, schema = str(tmp_path / "manifest"), "relative_path string, sha256 string, size_bytes long, modified_time double, chunk_count long, document_id string"
    entry = lambda name, sha: (name, sha, 1, 0.0, 2, name)
    corpus.write_manifest(spark.createDataFrame([entry("same", "1"), entry("changed", "1"), entry("gone", "1")], schema), path, 1, "r")
    old = corpus.read_manifest(spark, path, 1, "r")
    new = spark.createDataFrame([("same", "1"), ("changed", "2"), ("new", "1")], "relative_path string, sha256 string")
    plan = incremental.indexing_plan(old.select("relative_path", "sha256"), new)
    corpus.write_manifest(corpus.merge_manifest(old, plan, spark.createDataFrame([entry("changed", "2"), entry("new", "1")], schema)), path, 1, "r")
    got = sorted((r.relative_path, r.sha256) for r in corpus.read_manifest(spark, path, 1, "r").collect())
    assert got == [("changed", "2"), ("new", "1"), ("same", "1")]
    corpus.write_manifest(spark.createDataFrame([], schema), path, 1, "r")
    assert corpus.read_manifest(spark, path, 1, "r").count() == 0 and corpus.read_manifest(spark, path, 2, "r").count() == 0


def test_run_modes(spark):
    q = spark.range(10)
    assert [tables.mode_limit(q, m, "id", 5).count() for m in ("smoke", "manual", "benchmark")] == [3, 5, 10]
