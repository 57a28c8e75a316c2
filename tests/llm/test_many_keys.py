"""Many languages, and many rows without an id."""

from corpusloom.llm import langid, mixing, pu_quality


def test_many_languages_train(spark):
    rows = [(i, f"l{i % 1300:04d}", f"word{i % 1300} aa") for i in range(3900)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    languages, table, prior = langid.train(docs, ["a", "aa", "w", "o", "r", "d", *"0123456789"])
    assert 1200 < len(languages) == table.shape[1] == len(prior) and languages == sorted(languages)  # some have held-out rows only


def test_rows_without_ids_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_ROWS", 100)
    docs = spark.range(3000).selectExpr("if(id % 3 = 0, id, if(id % 3 = 1, null, 7)) as doc_id", "concat('words number ', id) as text", "'s' as source").repartition(3)
    shards = mixing._taken(docs, 17, 64, 2_000_000, 3, []).groupBy("shard").count().collect()
    assert len(shards) == 30 and max(r["count"] for r in shards) < 200
    nameless = mixing._taken(docs.filter("doc_id is null"), 17, 64, 2_000_000, 3, []).groupBy("shard").count().collect()
    assert len(nameless) == 10 and max(r["count"] for r in nameless) < 200
    first, again = (sorted(map(tuple, mixing.mix(docs).collect()), key=str) for _ in range(2))
    assert first == again and len(first) == 3000


def test_rows_without_ids_are_sampled(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(pu_quality, "write_table", lambda df, name: kept.append(df) or df)
    docs = spark.range(1400).selectExpr("if(id < 200, id, null) as doc_id", "concat('text number ', id) as text")
    labels = spark.createDataFrame([(i, 1) for i in range(100)], "doc_id long, quality int")
    pu_quality.train(docs, labels, per_side=300)
    numbers = [int(r.text.split()[-1]) for r in kept[-1].collect()]
    assert 200 < len(numbers) < 400 and 150 < sum(n >= 200 for n in numbers) < 350
