import numpy as np

from corpusloom.llm import ann


def test_nearest(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((12, 16))
    x = (centres[rng.integers(0, 12, 3000)] + rng.standard_normal((3000, 16))).astype(np.float32)
    x[100:400] = x[7]  # a very common vector
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(3000, None), (3020, [0.0] * 16), (3040, [float("nan")] + [1.0] * 15), (3060, [None] + [1.0] * 15), (3080, [1.0]), (None, rows[1][1]), rows[40]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "'clash' as list", "'clash' as score")
    got = ann.search(df, "vec_id", "embedding", 20, 20).collect()
    asked = {r.query_id for r in got}
    assert asked == {i for i in range(3000) if i % 20 == 0}
    hits = 0
    wide = x.astype(float)
    for q in asked:
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, 21)) and q not in {r.vec_id for r in mine}
        assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
        score = wide @ wide[q]
        assert all(abs(score[r.vec_id] - r.score) < 1e-9 for r in mine)
        score[q] = -np.inf
        hits += len(set(np.lexsort((np.arange(3000), -np.round(score, 9)))[:20].tolist()) & {r.vec_id for r in mine})
    assert hits / (20 * len(asked)) > 0.9
    assert ann.search(df.limit(0), "vec_id", "embedding", 20).count() == 0
    assert ann.search(df.filter("vec_id in (20, 21)"), "vec_id", "embedding", 20).count() == 1


def brute(x, ids, every, k):
    want = []
    for q in ids[ids % every == 0]:
        score = (x * x[ids == q][0]).sum(1)
        others = np.flatnonzero(ids != q)
        for rank, i in enumerate(others[np.lexsort((ids[others], -score[others]))[:k]], 1):
            want.append((int(q), rank, int(ids[i]), float(score[i])))
    return want


def search(spark, x, kind, **more):
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], f"vec_id long, embedding array<{kind}>")
    return [(r.query_id, r.rank, r.vec_id, r.score) for r in ann.search(df, "vec_id", "embedding", **more).orderBy("query_id", "rank").collect()]


def test_doubles_are_compared_as_doubles(spark):
    """Scores that floats can't tell apart, exact ties, and components beyond the range of floats."""
    x = np.ones((200, 4))
    x[:, 0] += np.arange(200) * 1e-9
    x[50:60] = x[50]
    ids = np.arange(200)
    assert search(spark, x, "double", every=20, k=20) == brute(x, ids, 20, 20)
    large = np.random.default_rng(0).standard_normal((60, 4)) * 1e150
    assert search(spark, large, "double", every=20, k=20) == brute(large, ids[:60], 20, 20)
    with np.errstate(over="ignore"):
        assert len(search(spark, large * 1e50, "double", every=20, k=20)) == 60


def test_reads_on_until_enough_are_found(spark):
    """Small lists far from a query: the nearest ones hold fewer vectors than it asks for."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((900, 8)) * 10
    old, ann.LEAST_LISTS, lists, ann.LIST = ann.LEAST_LISTS, 1, ann.LIST, 4
    try:
        got = search(spark, x, "double", every=100, k=60)
        alone = search(spark, x[:15], "double", every=5, k=20)
    finally:
        ann.LEAST_LISTS, ann.LIST = old, lists
    per = {q: sum(r[0] == q for r in got) for q in range(0, 900, 100)}
    assert set(per.values()) == {60}
    assert {q: sum(r[0] == q for r in alone) for q in (0, 5, 10)} == {0: 14, 5: 14, 10: 14}


def test_recall_where_few_lists_are_read(spark):
    """Some hundred lists, of which a query reads a small share."""
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((60, 24))
    x = (centres[rng.integers(0, 60, 8000)] + 0.6 * rng.standard_normal((8000, 24))).astype(np.float32)
    lists, ann.LIST = ann.LIST, 25
    try:
        got = search(spark, x, "float", every=100, k=20)
    finally:
        ann.LIST = lists
    want = brute(x.astype(float), np.arange(8000), 100, 20)
    assert len({(q, v) for q, _, v, _ in got} & {(q, v) for q, _, v, _ in want}) / len(want) > 0.9
