import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import answers, evaluation, records, tables
from corpusloom.sources import corpus


def test_each_file_once_over_several_roots(spark, tmp_path):
    (tmp_path / "samples" / "deep").mkdir(parents=True)
    (tmp_path / "raw").mkdir()
    (tmp_path / "samples" / "a.txt").write_text("a")
    (tmp_path / "samples" / "deep" / "b.txt").write_text("b")
    (tmp_path / "raw" / "a.txt").write_text("other a")
    (tmp_path / "raw2").mkdir()
    (tmp_path / "raw2" / "c.txt").write_text("c")
    roots = [str(tmp_path / r) for r in ("samples/deep", "samples", "nowhere", "raw", "raw2")]
    rows = sorted((r.root[len(str(tmp_path)) + 1 :], r.relative_path) for r in corpus.scan_roots(spark, roots).collect())
    assert rows == [("raw", "a.txt"), ("raw2", "c.txt"), ("samples", "a.txt"), ("samples/deep", "b.txt")]
    assert sorted(r.relative_path for r in corpus.scan_roots(spark, [f"file://{tmp_path}/samples", str(tmp_path / "samples/deep/")]).collect()) == ["a.txt", "deep/b.txt"]
    text = {r.text for r in corpus.load_text(corpus.scan_roots(spark, roots)).collect()}
    assert text == {"a", "b", "c", "other a"}
    with pytest.raises(FileNotFoundError):
        corpus.scan_roots(spark, [str(tmp_path / "nowhere")])


def test_samples_are_written_once(spark, tmp_path):
    root = str(tmp_path / "samples")
    corpus.write_samples(spark, root)
    files = corpus.scan_corpus(spark, root)
    assert {r.relative_path.split("/")[0] for r in files.collect()} == set(corpus.SAMPLES) == {r.relative_path for r in corpus.sample_documents(spark).collect()}
    assert sorted(r.text for r in corpus.load_text(files).collect()) == sorted(t.strip() for t in corpus.SAMPLES.values())
    before = {r.relative_path: r.modified_time for r in files.collect()}
    corpus.write_samples(spark, root)
    assert before == {r.relative_path: r.modified_time for r in corpus.scan_corpus(spark, root).collect()}


def test_holders_of_passages_of_any_length(spark, monkeypatch):
    monkeypatch.setattr(evaluation, "SHORT_PASSAGES", 2)
    rng = random.Random(1)
    words = ["an", "be", "cat", "Dog,", "e", "f\n"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))) for i in range(150)] + [(900, None), (901, ""), (902, "x an be cat an be cat y")]
    passages = [(i, rng.choice(docs[:150])[1][5 : 5 + rng.choice([1, 3, 6, 10, 15, 25, 40])]) for i in range(60)] + [(100, ""), (101, None), (102, "n be c"), (103, "nothing like this is in any text"), (104, "an be cat")]
    got = evaluation.holders(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(passages, "item_id long, passage string"), "item_id")
    want = sorted((k, d) for k, p in passages if p for d, t in docs if t and p in t)
    assert sorted(map(tuple, got.collect())) == want
    none = spark.createDataFrame([], "item_id long, passage string")
    assert evaluation.holders(spark.createDataFrame(docs, "doc_id long, text string"), none, "item_id").count() == 0


def test_times(spark):
    texts = ["2024-05-01T06:07:08.000009+00:00", "2024-05-01 06:07:08Z", "2024-05-01T06:07", "2024-05-01", " 2024-05-01T08:07:08+02:00 ", "soon", "", None, "2024-13-01", "12:00"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", X.parsed_time(F.col("t")).alias("p"))
    out = [r.shown for r in df.select("i", X.iso_time(F.col("p")).alias("shown")).orderBy("i").collect()]
    assert out == ["2024-05-01T06:07:08.000009+00:00", "2024-05-01T06:07:08.000000+00:00", "2024-05-01T06:07:00.000000+00:00", "2024-05-01T00:00:00.000000+00:00", "2024-05-01T06:07:08.000000+00:00", None, None, None, None, None]
    a, b = X.parsed_time(F.lit("2024-05-01")), X.parsed_time(F.lit("2024-05-01T00:00:01.5Z"))
    assert tuple(spark.range(1).select(X.elapsed_seconds(a, b), X.elapsed_seconds(b, a)).first()) == (1.5, 0.0)


def test_prompts(spark):
    q = spark.createDataFrame([(1, "Compare a and b"), (2, "Who?"), (3, "none")], "query_id long, question string")
    c = spark.createDataFrame([(1, "[1] x", True), (2, "[1] y", None), (3, "", False)], "query_id long, context string, weak_evidence boolean")
    out = {r.query_id: r.prompt for r in answers.detailed_prompts(q, c, least_words=500, most_words=100).collect()}
    assert "main differences" in out[1] and "weak" in out[1] and "at least 100 words" in out[1] and out[1].endswith("Question: Compare a and b")
    assert "direct answer" in out[2] and "weak" not in out[2] and out[3] is None
    runs = q.selectExpr("*", "if(query_id = 1, null, 'answered') as status", "null as plan", "'{}' as quality").withColumn("plan", F.lit(None).cast("string"))
    evidence = spark.createDataFrame([(1, 2, "c2", "s", 0.5, "second"), (1, 1, "c1", "s", None, 'first "quoted"')], "query_id long, rank long, chunk_id string, source string, score double, text string")
    out = {r.query_id: r for r in answers.composed_prompts(runs, evidence).collect()}
    assert out[1].evidence_count == 2 and out[1].prompt.index("first") < out[1].prompt.index("second") and "Status:\nunknown" in out[1].prompt
    assert out[2].prompt.endswith("Evidence:\n[]") and out[2].evidence_count == 0


def test_document_and_citation_tables(spark):
    docs = spark.createDataFrame([("ab", "s", "x"), (None, "s", None), ("abcd", "t", "x")], "text string, source string, kind string")
    out = {(r.dimension, r.value): tuple(r)[2:] for r in tables.document_report(docs, ["kind"]).collect()}
    assert out == {("all", "all"): (3, 6, 2.0, 2), ("kind", "x"): (2, 6, 3.0, 2), ("kind", "unknown"): (1, 0, 0.0, 1)}
    rows = spark.createDataFrame([("d", 1, "c", 0.0, "p"), ("d", 1, "", 0.5, "p"), ("d", None, "c", 0.5, "p")], "document string, page_number int, chunk_id string, score double, source_path string")
    assert [r.metadata_complete for r in records.citation_quality(rows).collect()] == [True, False, False]
    results = spark.createDataFrame([(1, "a", "x"), (1, "b", "y"), (1, "c", "z")], "query_id long, chunk_id string, technique string")
    sections = spark.createDataFrame([(1, 1, ["a", "b"]), (1, 2, ["a"])], "query_id long, section long, chunk_ids array<string>")
    assert sorted(map(tuple, tables.final_sections(results, sections).collect())) == [("x", 2), ("y", 1), ("z", 0)]
