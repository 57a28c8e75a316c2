import json

from pyspark.sql import functions as F

from corpusloom.sources import corpus
from corpusloom.streaming import events as E


def test_corpus_scan_and_text(spark, tmp_path):
    root = tmp_path / "corpus"
    (root / "cat" / "col").mkdir(parents=True)
    (root / "cat" / "col" / "a.html").write_text("<p>One  two</p><script>x = 1</script>")
    (root / "cat" / "b.json").write_text('{"k": [1]}')
    (root / "c.csv").write_text("a,b\n1,2\n")
    (root / "d.txt").write_bytes("caf\xe9".encode("latin-1"))
    (root / "empty.txt").write_text("  ")
    (root / "e.zip").write_bytes(b"x")
    files = corpus.scan_corpus(spark, str(root))
    rows = {r.relative_path: r for r in files.collect()}
    assert set(rows) == {"cat/col/a.html", "cat/b.json", "c.csv", "d.txt", "empty.txt"}
    assert (rows["cat/col/a.html"].category, rows["cat/col/a.html"].collection, rows["c.csv"].category) == ("cat", "col", None)
    text = {r.relative_path: r.text for r in corpus.load_text(files).collect()}
    assert text == {"cat/col/a.html": "One two\nx = 1", "cat/b.json": '{\n  "k": [\n    1\n  ]\n}', "c.csv": "a | b\n1 | 2", "d.txt": "café"}


def test_lossy_text(spark):
    rows = spark.createDataFrame([(bytearray("﻿é".encode()),), (bytearray(b"\xe9"),)], "c binary").select(corpus.lossy_text(F.col("c")).alias("t"))
    assert [r.t for r in rows.collect()] == ["é", "é"]


def test_benchmark_and_questions(spark, tmp_path):
    (tmp_path / "b.csv").write_text('question_id,question,answer,expected_keywords,should_answer,owner\n,First?,yes,"a, b",,me\nx,,skipped,,,\n,Third?,no,,no,you\n')
    rows = corpus.load_benchmark(spark, str(tmp_path / "b.csv")).collect()
    assert [(r.question_id, r.question, r.expected_answer, r.expected_keywords, r.should_answer, r.metadata) for r in rows] == [
        ("1", "First?", "yes", ["a", "b"], True, {"owner": "me"}), ("3", "Third?", "no", [], False, {"owner": "you"})]
    (tmp_path / "q.txt").write_text("one\n\n two \n")
    assert [r.question for r in corpus.load_questions(spark, str(tmp_path / "q.txt")).collect()] == ["one", "two"]


def test_manifest_and_checkpoint(spark, tmp_path):
    path = str(tmp_path / "manifest")
    assert corpus.read_manifest(spark, path, 1, "r").count() == 0
    entries = spark.createDataFrame([("a", "1", 1, 1.0, 1, "d")], "relative_path string, sha256 string, size_bytes long, modified_time double, chunk_count long, document_id string")
    corpus.write_manifest(entries, path, 1, "r")
    assert corpus.read_manifest(spark, path, 1, "r").count() == 1 and corpus.read_manifest(spark, path, 2, "r").count() == 0
    (tmp_path / "c.jsonl").write_text(json.dumps({"key": "a", "ordinal": 1, "row": "x"}) + '\n{"key": "b", "ord')
    assert [r.key for r in corpus.read_checkpoint(spark, str(tmp_path / "c.jsonl")).collect()] == ["a"]


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source = str(tmp_path / "in")
    events.repartition(3).write.parquet(source)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)

    def finished(df, name, mode):
        query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        query.awaitTermination(120)
        return sorted(map(str, spark.table(name).collect()))

    assert finished(E.tumbling(stream, "1 day", "event_type", "value"), "tumbling_out", "complete") == sorted(map(str, E.tumbling(events, "1 day", "event_type", "value").collect()))

    def runs(df):
        return df.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "view", "question_completed").otherwise("other").alias("event_type"), F.col("value").alias("elapsed_seconds"))

    assert finished(E.progress(runs(stream), 100), "progress_out", "complete") == sorted(map(str, E.progress(runs(events), 100).collect()))


def test_handlers_do_not_keep_each_other_from_a_batch(spark, tmp_path):
    source, seen = str(tmp_path / "in"), []
    spark.range(5).write.parquet(source)
    stream = spark.readStream.schema("id long").parquet(source)

    def fails(batch, number):
        raise RuntimeError("broken handler")

    query = E.write_each(stream, [fails, lambda b, n: seen.append(b.count())], str(tmp_path / "check")).trigger(availableNow=True).start()
    try:
        query.awaitTermination(60)
    except Exception as e:
        assert "event handlers failed" in str(e)
    assert seen == [5]
