import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from corpusloom.functions import codec
from corpusloom.operators import evaluation, incremental, reviews, tables
from corpusloom.sources import resume


def test_word_codec(spark):
    texts = ["", None, "one", " two  words ", "a b\nc d e f", "x " * 50]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    c, count = codec.Words(), codec.Words().counter()
    for most in (0, 1, 3, 50):
        for i, n, cut in df.select("i", c.count(F.col("t")), c.truncate(F.col("t"), most)).collect():
            assert n == count(texts[i] or "")
            assert cut == (texts[i] or "") if n <= most else (cut == cut.rstrip() and (texts[i]).startswith(cut) and count(cut) == most)
    assert df.select(c.remaining(F.lit(3), F.lit(10))).first()[0] == 7
    for used, most in ((-1, 3), (1, 0), (4, 3)):
        with pytest.raises(PySparkException):
            df.select(c.remaining(F.lit(used), F.lit(most))).collect()


def test_encoded_codec_counts_again_after_trimming(spark):
    """A codec by pairs of characters, whose trimmed text can have as many tokens as before."""
    def make():
        return (lambda t: [t[i : i + 2] for i in range(0, len(t), 2)]), (lambda ids: "".join(ids))

    c = codec.Encoded(make)
    df = spark.createDataFrame([("abcdefgh",), ("ab  cd",), (None,), ("a",)], "t string")
    assert [r[0] for r in df.select(c.count(F.col("t"))).collect()] == [4, 3, 0, 1]
    assert [r[0] for r in df.select(c.truncate(F.col("t"), 2)).collect()] == ["abcd", "ab", "", "a"]
    assert codec.shortened("ab cd", 1, lambda t: t.split(" ") + ["!"] * t.count("b"), " ".join) == ""
    assert c.counter()("abc") == 2


def asked(spark, n):
    return spark.createDataFrame([(i, f"question {i % 7}") for i in range(1, n + 1)], "index long, question string")


def test_a_killed_run_goes_on(spark, tmp_path):
    path, seen = str(tmp_path / "run"), []
    resume.begin(path, asked(spark, 40), files=5)

    def answer(dies_at):
        def of(batch):
            rows = [r["index"] for r in batch.orderBy("index").collect()]
            seen.append(rows)
            if len(seen) == dies_at:
                raise RuntimeError("killed")
            return batch.select("key", F.upper("question").alias("answer"))
        return of

    with pytest.raises(Exception, match="killed"):
        resume.run(spark, path, answer(3))
    assert resume.results(spark, path).count() == sum(map(len, seen[:2]))
    with pytest.raises(RuntimeError, match="has no result"):
        resume.finished(spark, path)
    before = len(seen)
    resume.begin(path, asked(spark, 40))
    resume.run(spark, path, answer(0))
    out = resume.finished(spark, path).orderBy("index").collect()
    assert [(r["index"], r.answer) for r in out] == [(i, f"QUESTION {i % 7}") for i in range(1, 41)]
    # what was answered before the run was killed isn't asked again
    again = {i for rows in seen[before:] for i in rows}
    assert again.isdisjoint({i for rows in seen[:2] for i in rows})
    resume.run(spark, path, answer(0))
    assert resume.finished(spark, path).count() == 40
    (tmp_path / "other").mkdir()
    spark.createDataFrame([("9:x", "?")], "key string, answer string").write.parquet(f"{path}/results/batch=77")
    with pytest.raises(RuntimeError, match="is no question"):
        resume.finished(spark, path)


def test_other_questions_are_refused(spark, tmp_path):
    path = str(tmp_path / "run")
    resume.begin(path, asked(spark, 5))
    with pytest.raises(resume.WrongQuestions, match="question 6"):
        resume.begin(path, asked(spark, 6))
    with pytest.raises(resume.WrongQuestions, match="question 2"):
        resume.begin(path, asked(spark, 5).withColumn("index", F.when(F.col("index") == 2, 3).when(F.col("index") == 3, 2).otherwise(F.col("index"))))
    for bad in (asked(spark, 5).filter("index <> 3"), asked(spark, 5).withColumn("index", F.lit(1)), asked(spark, 2).withColumn("question", F.lit(None).cast("string"))):
        with pytest.raises(resume.WrongQuestions, match="places"):
            resume.begin(str(tmp_path / "new"), bad)


def test_tree_fingerprint(spark):
    rows = [(i, f"t{i % 50}") for i in range(700)]

    def of(rows, parts=3, **more):
        df = spark.createDataFrame(rows, "at long, text string").repartition(parts)
        return tuple(incremental.tree_fingerprint(df, ["at"], ["text"], fanout=8, **more).first())

    first = of(rows)
    assert first == of(rows, 1) == of(list(reversed(rows)), 7)
    swapped = [(0, rows[1][1]), (1, rows[0][1]), *rows[2:]]
    others = [swapped, rows[:-1], [*rows, (700, "t0")], [(0, None), *rows[1:]], [(0, ""), *rows[1:]], []]
    assert len({first, *map(of, others)}) == 7
    numbers = incremental.numbered(spark.createDataFrame(rows, "at long, text string").repartition(5), ["at"])
    assert all(r.at == r.number for r in numbers.collect())


def test_aggregate_experiment_with_gaps(spark):
    rows = [("e1", "a", "easy", True, True, False, "2.5", 1.0), ("e1", None, "hard", False, None, True, "x", None), ("e1", "a", None, False, False, False, None, 4.0), ("e2", "b", "easy", None, True, None, "1", 2.0)]
    df = spark.createDataFrame(rows, "experiment_id string, category string, difficulty string, passed boolean, should_answer boolean, hallucinated boolean, keyword_score string, total_latency double")
    out = {(r.experiment_id, r.dimension, r.value): r for r in evaluation.aggregate_experiment(df).collect()}
    assert set(out) == {("e1", "all", "all"), ("e2", "all", "all"), ("e1", "category", "a"), ("e1", "category", "uncategorized"), ("e2", "category", "b"), *[("e1", "difficulty", d) for d in ("easy", "hard", "unknown")], ("e2", "difficulty", "easy")}
    e1 = out["e1", "all", "all"]
    assert (e1.question_count, e1.answer_accuracy, e1.supported_answer_accuracy, e1.unsupported_question_accuracy, e1.hallucination_rate) == (3, 0.333333, 0.5, 0.0, 0.333333)
    assert (e1.keyword_coverage, e1.average_latency, e1.average_context_tokens) == (0.833333, 1.666667, 0.0)
    records = {r.experiment_id: r for r in evaluation.experiment_records(evaluation.aggregate_experiment(df)).collect()}
    assert records["e1"].pass_rate_by_category == {"a": 0.5, "uncategorized": 0.0} and records["e2"].pass_rate_by_difficulty == {"easy": 0.0}
    assert evaluation.aggregate_experiment(df.limit(0)).count() == 0
    ranked = evaluation.rank_experiments(evaluation.aggregate_experiment(df).filter("dimension = 'all'"))
    assert evaluation.tradeoffs(ranked).count() == 1 and evaluation.tradeoffs(ranked.limit(0)).count() == 0


def test_reranking_metrics_and_run_report_without_rows(spark):
    rows = spark.createDataFrame([], "token_reduction_percent double, average_reranker_score double, selected_chunk_count long, discarded_chunk_count long, selected_evidence_tokens long, weak_evidence boolean, strengths map<string,long>, discard_reasons map<string,long>")
    out = {(r.metric, r.name): r.value for r in evaluation.reranking_metrics(rows).collect()}
    assert set(out.values()) == {0.0} and len(out) == 12
    one = spark.createDataFrame([(1.0, None, 2, 3, 4, None, {"strong": 2}, None), (3.0, 1.0, 0, 1, 0, True, None, {"redundancy": 1})], rows.schema)
    out = {(r.metric, r.name): r.value for r in evaluation.reranking_metrics(one).collect()}
    assert out["average_token_reduction_percent", None] == 2.0 and out["average_reranker_score", None] == 0.5 and out["discarded_chunk_count", None] == 4.0
    assert out["evidence_strength", "strong"] == 2.0 and out["discard_reason", "redundancy"] == 1.0 and out["weak_evidence_question_count", None] == 1.0
    empty = spark.createDataFrame([], "status string, answer_status string, total_latency double, retrieval_latency double, retrieved_chunks long, context_tokens long, passed boolean, hallucinated boolean, citation_quality double")
    r = evaluation.run_report(empty).first()
    assert (r.question_count, r.average_latency_seconds, r.answer_accuracy) == (0, 0.0, None)


def test_review_counts(spark):
    issues = spark.createDataFrame([("Missing section and poor structure",), ("repeated, INCOMPLETE",), (None,), ("fine",)], "issue string")
    out = {r.category: r.issues for r in reviews.critic_categories(issues).collect()}
    assert (out["Completeness"], out["Structure"], out["Repetition"], out["Missing caveats"]) == (2, 1, 1, 0) and len(out) == 6
    risks = [("r", 1, "Aviation_Safety", "low", None, None), ("r", 2, "aviation safety", "high", "rare", "done"), ("r", 3, "other", "high", "rare", "done"), ("s", 1, None, None, None, None)]
    out = reviews.risk_matrix(spark.createDataFrame(risks, "run string, ordinal long, category string, severity string, likelihood string, mitigation string"), "run").collect()
    assert len(out) == 10 and [tuple(r) for r in out if r.severity != "not assessed"] == [("r", "aviation safety", "high", "rare", "done")]
    rng = random.Random(0)
    evidence = spark.createDataFrame([("q", rng.choice("abcdefghijklm"), rng.choice(["", None, "x"])) for _ in range(300)], "query_id string, source string, kind string")
    out = reviews.source_diversity(evidence, ["source", "kind"], by=["query_id"]).collect()
    assert len([r for r in out if r.dimension == "source"]) == 8 and {r.value for r in out if r.dimension == "kind"} == {"unknown", "x"}


def test_heatmap_states_its_columns(spark):
    df = spark.createDataFrame([("a", "1", 1.0), ("a", "2", 2.0), ("a", "2", 3.0), (None, "3", 9.0)], "y string, x string, v double")
    assert sorted(map(tuple, tables.heatmap(df, "x", "y", "v", ["1", "2"]).collect()), key=str) == [("a", 1.0, 2.5), (None, 0.0, 0.0)]
    for bad in ([], ["1", "1"], [str(i) for i in range(999)]):
        with pytest.raises(ValueError):
            tables.heatmap(df, "x", "y", "v", bad)
