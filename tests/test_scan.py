"""Texts ranked where they are read: the results of postings, and how little of the corpus moves."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import evaluation, lexical
from corpusloom.plans import catalog

SF = "/root/testdata/sf0.001"


def shuffled(spark) -> dict[int, int]:
    """Rows that each stage so far has written for a shuffle."""
    jvm, sc = spark._jvm, spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return {(s := stages.apply(i)).stageId(): s.shuffleWriteRecords() for i in range(stages.size())}


@pytest.mark.parametrize("repeats", [False, True])
def test_scan_equals_postings(spark, monkeypatch, repeats):
    for name, value in (("QUERY_GROUP", 7), ("CELLS", 90), ("TEXTS", 16)):
        monkeypatch.setattr(lexical, name, value)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    said = lambda n: " ".join(rng.choices(words, [1 / (i + 1) for i in range(40)], k=n))
    texts = [(f"t{i}", said(rng.randint(0, 30))) for i in range(300)] + [("none", None), ("zz", "w1 w1 w30"), ("za", "w1 w1 w30"), ("aé", "w1 w1 w30")]
    texts += [("t5", said(9)), ("t5", said(9)), (None, said(9)), (None, said(4))] if repeats else []
    corpus = spark.createDataFrame(texts, "chunk_id string, text string").repartition(3)
    queries = spark.createDataFrame([(i, said(rng.randint(0, 12))) for i in range(30)] + [(30, "w1 w30"), (31, "unknown"), (32, "w1 w30")], "query_id int, query string")
    want = lexical.search(queries, lexical.index(corpus), 4)
    got = lexical.bm25_topk(queries, corpus, 4)
    assert got.columns == want.columns and want.count() > 100
    key = lambda r: (r.query_id, r["rank"])
    assert [(*key(r), r.chunk_id, pytest.approx(r.score, abs=2e-6)) for r in sorted(want.collect(), key=key)] == [(*key(r), r.chunk_id, r.score) for r in sorted(got.collect(), key=key)]


@pytest.mark.parametrize("name", ["merge_sections", "hybrid_topk"])
def test_rankings_move_a_part_of_the_words(spark, tmp_path, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.crossJoin(spark.range(20)).withColumn("doc_id", F.col("doc_id") + 1000 * F.col("id")).drop("id").write.parquet(str(tmp_path / "documents.parquet"))
    for other in ("benchmark", "embeddings"):
        spark.read.parquet(f"{SF}/{other}.parquet").write.parquet(str(tmp_path / f"{other}.parquet"))
    before = shuffled(spark)
    assert catalog.QUERIES[name](spark, str(tmp_path)).count() > 80
    moved = sum(n for stage, n in shuffled(spark).items() if stage not in before)
    words = docs.select(F.sum(F.size(F.split("text", " ")))).first()[0] * 20
    assert moved < words / 4


def test_texts_stay_where_passages_are_looked_for(spark, tmp_path):
    rest = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(20)), lambda i: F.sha2(F.concat_ws(":", "id", i), 256)))
    some = F.when(F.col("id") < 3, "one two three four five six seven eight").otherwise("nothing")
    spark.range(2000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("a b c d"), some, rest).alias("text")).write.parquet(str(tmp_path / "docs"))
    passages = spark.createDataFrame([(1, "one two three four five six seven eight"), (None, "two three four five"), (2, "is in no text at all"), (1, "d one two three")], "item_id long, passage string")
    held, before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), shuffled(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "256k")  # the texts are larger
    try:
        assert sorted(evaluation.holders(spark.read.parquet(str(tmp_path / "docs")), passages, "item_id").collect(), key=str) == [(1, 0), (1, 1), (1, 2), (None, 0), (None, 1), (None, 2)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert sum(n for stage, n in shuffled(spark).items() if stage not in before) < 1000
